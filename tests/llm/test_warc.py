"""WARC bundles: round trip, seek table, revisits, odd rows."""

import base64
import hashlib

import pytest
import zstandard

from drawstat.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [(i, f"http://h/{i}?q=ü a\r\nX: y", f"<p>page {i} é\r\n\r\n</p>" * (i % 7 + 1)) for i in range(60)]
PAGES += [(100 + i, "http://copy", "<b>same</b>") for i in range(20)] + [(200, None, None), (201, "u", ""), (202, "u", "x" * 300_000)]
SCHEMA = "page_id bigint, url string, html string"


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], SCHEMA + ", payload string, revisit int").repartition(3)
    index = warc.write_archives(rows, str(tmp_path / "out"), frame_bytes=2000, archive_bytes=300)
    found = {r.page_id: r for r in warc.read_archives(index).collect()}
    assert len(found) == len(PAGES)
    stored = {}
    for i, _, h in PAGES:
        stored[h or ""] = max(i, stored.get(h or "", -1))
    for i, _, h in PAGES:
        r, owner = found[i], stored[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if i == owner else ("revisit", owner))
        assert r.payload == ((h or "").encode() if i == owner else None)
    assert index.select("archive").distinct().count() > 3  # archives roll over


def test_frames_are_independent_and_found_through_the_seek_table(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), str(tmp_path / "out"), frame_bytes=1500).collect()
    assert len({r.archive for r in index}) == 1 and len(index) > 5
    reader = warc.ArchiveReader(index[0].archive)
    assert len(reader) == len(index)
    for r in reversed(index):
        raw = reader.frame(r.frame)
        assert len(raw) == r.raw_bytes
        for rec in r.records:
            fields, _, _ = warc.parse(raw[rec["at"]:rec["at"] + rec["length"]])
            assert fields["WARC-Record-ID"] == rec.record_id
    # a plain reader sees the frames one after the other and skips the table
    with open(index[0].archive, "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def test_lookup_reads_single_records(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), str(tmp_path / "out"), frame_bytes=1500)
    wanted = spark.createDataFrame([(warc.record_id(i),) for i in (3, 202, 999)], "record_id string")
    assert sorted(r.page_id for r in warc.lookup(index, wanted).collect()) == [3, 202]


def test_min_bytes_repeated_rows_null_ids(spark, tmp_path):
    rows = [(1, "a", "tiny"), (2, "a", "tiny"), (5, "b", "long enough"), (5, "b", "long enough"), (4, "c", "long enough"), (None, "d", "long enough"),
            (None, "e", "alone")]
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), min_bytes=6)
    found = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_archives(index).collect())
    assert found == [("1", "response", "None"), ("2", "response", "None"), ("4", "revisit", "5"), ("5", "response", "None"), ("5", "response", "None"),
                     ("None", "response", "None"), ("None", "revisit", "5")]


def test_empty_table_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(empty, str(tmp_path / "none"))).count() == 0
    bad = tmp_path / "bad.warc.zst"
    bad.write_bytes(b"0" * 40)
    with pytest.raises(ValueError, match="seek table"):
        warc.ArchiveReader(str(bad))
