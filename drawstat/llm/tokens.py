"""Tokenizers inside tasks. Vocabularies stay where they are installed; their name or path is a parameter."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: white space beyond ASCII, as the byte-level pattern's \\s has it.
_WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = frozenset(" \t\n\r\x0b\x0c") | {""}
_OTHER, _SPACE, _WORD, _MARK = range(4)
_KIND = np.array([_SPACE if i in b" \t\n\r\x0b\x0c" else _OTHER if i > 127 else _WORD if chr(i).isalnum() else _MARK for i in range(256)], np.uint8)


def vocabulary(name: str) -> str:
    """Path of a vocabulary: a path as it is, a bare name as the public tokenizers know it."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE of the tokenizers library over batches of texts.

    Text splits at every run of white space that follows something else and at every ASCII mark that follows an
    ASCII letter or digit; no token crosses such a place, so a text is the sequence of its chunks and equal chunks are encoded once. Chunks new to the cache are glued to
    long strings and encoded in one call; token lengths in bytes tell them apart again. Texts with white
    space beyond ASCII or with the name of an added token are encoded whole."""

    def __init__(self, path: str, cached: int = 600_000):
        from tokenizers import Tokenizer
        self._tokenizer, self._cached, self._known = Tokenizer.from_file(path), cached, {}
        self.size = self._tokenizer.get_vocab_size()
        self._bytes = np.zeros(self.size, np.int64)
        for token, number in self._tokenizer.get_vocab().items():
            self._bytes[number] = len(token)
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._odd = re.compile("|".join([_WIDE_SPACE, *added]))

    @classmethod
    def shared(cls, name: str) -> Encoder:
        """One encoder per worker process, kept over tasks."""
        import tokenizers
        held = tokenizers.__dict__.setdefault("_held_encoders", {})
        path = vocabulary(name)
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        glued, single = [], []
        for c in chunks:
            (glued if c[:1] in _SPACES and c[-1:] not in _SPACES else single).append(c)
        for c, ids in zip(single, self.whole(single)):
            self._known[c] = np.array(ids, np.uint32).tobytes()
        for at in range(0, len(glued), 4096):
            part = glued[at:at + 4096]
            ids = np.array(self.whole(["".join(part)])[0], np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy())
            cuts = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
            data = ids.tobytes()
            for c, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist()):
                self._known[c] = data[4 * a:4 * b]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = [i for i, t in enumerate(texts) if self._odd.search(t.as_py())]
        if odd:
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            ids, counts = self.encode(texts.filter(pa.array(plain)))
            out, at, parts = np.zeros(len(texts), np.int64), 0, []
            out[plain] = counts
            encoded = dict(zip(odd, self.whole([texts[i].as_py() for i in odd])))
            for i in range(len(texts)):
                if i in encoded:
                    out[i] = len(encoded[i])
                    parts.append(np.array(encoded[i], np.uint32))
                else:
                    parts.append(ids[at:at + out[i]])
                    at += out[i]
            return np.concatenate(parts), out
        texts = pa.concat_arrays([texts])  # offsets from zero
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = _KIND[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] == _SPACE) & (kind[:-1] != _SPACE) | (kind[1:] == _MARK) & (kind[:-1] == _WORD)
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        encoded = chunks.dictionary_encode()
        words = encoded.dictionary.to_pylist()
        if len(self._known) > self._cached:
            self._known.clear()
        self._learn([w for w in words if w not in self._known])
        found = [self._known[w] for w in words]
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        which = encoded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[which] - (ends - lengths), lengths)
        until = np.concatenate([[0], ends])
        return flat[at], np.diff(until[np.searchsorted(cuts, offsets)])


def rank_encoder(name: str):
    """The same vocabulary given as ranks, for fast whole-text encoding; one per worker process, with the
    length of every token in bytes."""
    import public_tokenizers
    import tiktoken
    held = tiktoken.__dict__.setdefault("_held_encoders", {})
    path = vocabulary(name)
    if path not in held:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        held[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return held[path]
