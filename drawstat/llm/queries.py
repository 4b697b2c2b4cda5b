"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawstat.llm import (alignment, decontaminate, embedding_forest, hilbert, line_dedup, link_graph, merkle, packing, simhash,
                          token_counts, toxicity, warc, wavelet)
from drawstat.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet matrices and read back."""
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that later occurrences of three-line windows cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, cosine at least 0.93 within a label."""
    return embedding_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links join fingerprints at most three bits apart."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 8,192 bytes without two of one source or of one SimHash component."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_texts(docs, clusters=simhash.near_duplicates(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; ``flagged`` compares it with the threshold of the language."""
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= F.col("threshold")).alias("flagged"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses lines goes to the one with most of it."""
    return token_counts.count_sections(table(spark, sf_dir, "documents"))


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 runs of the Hilbert curve over language, source and length."""
    placed = hilbert.shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a window of 20 of its tokens, up to a fifth of tokens replaced."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "matched", "compared")


def op11_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page: the longest rule that fits, else trust and distrust of its host."""
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf, proven against the root; of half the documents the text is checked without line feeds."""
    chosen = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 2 == 0
    altered = F.when(chosen, F.translate("text", "\n", ""))
    checked = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), altered))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies over the same bytes of every document, their common cuts and links."""
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_wavelet": op2_wavelet,
    "op3_line_dedup": op3_line_dedup,
    "op4_forest": op4_forest,
    "op5_simhash": op5_simhash,
    "op6_best_fit": op6_best_fit,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_hilbert": op9_hilbert,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_link_graph": op11_link_graph,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS stored FROM p),
b AS (SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
                                  '1101', '1110', '1111'][instr('0123456789abcdef', c)] FOR c IN string_split(x, '')], '') AS bits FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INTEGER + 8 * bits[5 * i + 2]::INTEGER
                        + 4 * bits[5 * i + 3]::INTEGER + 2 * bits[5 * i + 4]::INTEGER + bits[5 * i + 5]::INTEGER] FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM b
""",
    "op4_forest": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id JOIN c ON c.n = vec_id
""",
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM lines WHERE len(l) >= 3)),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth
  FROM windows WHERE trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS q FROM ranked WHERE nth > 1),
placed AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS q FROM lines),
kept AS (
  SELECT placed.doc_id, string_agg(line, chr(10) ORDER BY placed.q) AS text, count(*) AS n
  FROM placed ANTI JOIN gone ON placed.doc_id = gone.doc_id AND placed.q = gone.q GROUP BY placed.doc_id)
SELECT lines.doc_id, CASE WHEN lines.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(l), 0)::INTEGER AS n_lines, (coalesce(len(l), 0) - coalesce(kept.n, 0))::INTEGER AS n_removed
FROM lines LEFT JOIN kept ON lines.doc_id = kept.doc_id
""",
    "op10_spaced_seeds": """
WITH masks(m, o) AS (VALUES (0, [0, 1, 2, 3, 4]), (1, [0, 1, 5, 6, 8]), (2, [0, 3, 5, 7, 8]), (3, [0, 1, 4, 6, 7])),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
lost(n, runs) AS (SELECT n, n - ceil(0.8 * n - 1e-9)::INTEGER + 1 FROM (SELECT unnest(range(1, 14)) AS n)),
runs AS (SELECT n, (k * n) // runs AS a, ((k + 1) * n) // runs AS b FROM (SELECT n, runs, unnest(range(0, runs)) AS k FROM lost)),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
ip AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 14),
ds AS (SELECT doc_id, p, m, concat_ws(' ', w[p + o[1]], w[p + o[2]], w[p + o[3]], w[p + o[4]], w[p + o[5]]) AS s
       FROM dp, masks WHERE p + o[5] <= len(w)),
js AS (SELECT item_id, p, m, concat_ws(' ', w[p + o[1]], w[p + o[2]], w[p + o[3]], w[p + o[4]], w[p + o[5]]) AS s
       FROM ip, masks WHERE p + o[5] <= len(w)),
hits AS (
  SELECT DISTINCT doc_id, item_id, ds.p - js.p AS g FROM ds JOIN js ON ds.m = js.m AND ds.s = js.s
  UNION
  SELECT DISTINCT doc_id, item_id, dp.p - 1 - runs.a AS g FROM i JOIN runs ON runs.n = len(i.w)
  JOIN dp ON array_to_string(dp.w[dp.p:dp.p + runs.b - runs.a - 1], ' ') = array_to_string(i.w[runs.a + 1:runs.b], ' ')),
flags AS (
  SELECT doc_id, item_id, g, least(len(i.w), 20) AS c, len(i.w) AS n,
         [CASE WHEN q + g >= 1 AND d.w[q + g] = i.w[q] THEN 1 ELSE 0 END FOR q IN range(1, len(i.w) + 1)] AS f
  FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)),
scored AS (
  SELECT doc_id, item_id, g, c, list_max([list_sum(f[a:a + c - 1]) FOR a IN range(1, n - c + 2)]) AS k FROM flags),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k DESC, g) AS nth FROM scored WHERE k >= c * 0.8)
SELECT doc_id, item_id, g::INTEGER AS doc_start, k::INTEGER AS matched, c::INTEGER AS compared FROM best WHERE nth = 1
""",
    "op11_link_graph": r"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS id, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT id, page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, p, allow) AS (VALUES ('org', '/', TRUE), ('example.org', '/es/', FALSE), ('example.org', '/en/1', FALSE), ('com', '/fr/', TRUE), ('com', '/de/', FALSE)),
fits AS (
  SELECT id, h || rules.p AS rule, allow, row_number() OVER (PARTITION BY id ORDER BY len(h || rules.p) DESC, len(h) DESC, allow) AS nth
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)),
ruled AS (SELECT p.id, page_id, host, path, rule, allow FROM p LEFT JOIN fits ON p.id = fits.id AND nth = 1),
named AS (
  SELECT DISTINCT id, host, translate(unnest(regexp_extract_all(html,
    '<[aA][ \t\n\f\r][^>]*?[hH][rR][eE][fF][ \t\n\f\r]*=[ \t\n\f\r]*["\x27]?[ \t\n\f\r]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"\x27> \t\n\f\r]+)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS other FROM p WHERE html IS NOT NULL),
links AS (SELECT host, other, count(*) AS pages FROM named WHERE host <> '' AND host <> other GROUP BY ALL),
flows AS (
  SELECT kind, host, other, share, sum(share) OVER (PARTITION BY kind, host) AS total
  FROM (SELECT 'trust' AS kind, host, other, pages AS share FROM links UNION ALL SELECT 'distrust', other, host, pages FROM links)),
x(k, kind, host, mass) AS (
  SELECT 0, CASE WHEN allow THEN 'trust' ELSE 'distrust' END, host, (count(*) * 1000000)::HUGEINT FROM ruled WHERE rule IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT x.k + 1, x.kind, flows.other, sum((mass * 85 // 100) * share // total)::HUGEINT
  FROM x JOIN flows ON x.kind = flows.kind AND x.host = flows.host WHERE x.k < 12 GROUP BY x.k, x.kind, flows.other),
scores AS (
  SELECT host, sum(CASE kind WHEN 'trust' THEN mass ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN mass ELSE 0 END) AS distrust FROM x GROUP BY host)
SELECT page_id, ruled.host, path, rule,
       CASE WHEN coalesce(NOT allow, coalesce(distrust, 0) > coalesce(trust, 0)) THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM ruled LEFT JOIN scores ON ruled.host = scores.host
""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, * FROM documents),
bits AS (
  SELECT id, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')]) AS steps FROM d),
chosen AS (  -- the lowest bit of CRC-32, one step for every bit of the decimal id
  SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, steps),
      lambda r, v: xor(xor(r, v) >> 1, CASE WHEN xor(r, v) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 2 = 0 AS tampered FROM bits),
f AS (
  SELECT id, doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS other FROM d JOIN chosen USING (id)),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS altered FROM f),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low(source, l, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT source, l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, l, pos // 3, n),
sub AS (
  SELECT source, h AS subroot, l AS height, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(l, pos, n, h) AS (
  SELECT 0, place, n, subroot FROM sub
  UNION ALL
  SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY l, pos // 3, n),
pairs AS (  -- siblings of every node of the sources' trees, then of the tree above
  SELECT source, a.l, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM (SELECT source, l, pos, n FROM low UNION ALL SELECT 'above', l - 1000, pos, n FROM high) a
  JOIN (SELECT source AS s, l, pos, n, h FROM low UNION ALL SELECT 'above', l - 1000, pos, n, h FROM high) b
    ON a.source IS NOT DISTINCT FROM b.s AND a.l = b.l AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY source, a.l, a.pos),
ways AS (
  SELECT id, list({'b': before, 'a': after} ORDER BY l) AS way FROM (
    SELECT p.id, pairs.l AS l, before, after FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
      JOIN pairs ON pairs.source IS NOT DISTINCT FROM p.source AND pairs.l >= 0 AND pairs.l < height AND pairs.pos = p.pos // (3 ** pairs.l)::BIGINT
    UNION ALL
    SELECT p.id, pairs.l + 2000, before, after FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
      JOIN pairs ON pairs.source = 'above' AND pairs.l < 0 AND pairs.pos = sub.place // (3 ** (pairs.l + 1000))::BIGINT) GROUP BY id),
folded(id, k, node) AS (
  SELECT id, 0, altered FROM placed
  UNION ALL
  SELECT folded.id, k + 1, sha256(way[k + 1].b || node || way[k + 1].a) FROM folded JOIN ways ON folded.id = ways.id WHERE k < len(way))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string([w.b || w.a FOR w IN way], ''), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source LEFT JOIN ways ON ways.id = placed.id
JOIN folded ON folded.id = placed.id AND folded.k = coalesce(len(way), 0), (SELECT h AS root FROM high WHERE n = 1)
""",
}
