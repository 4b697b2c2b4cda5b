"""Merkle manifest of a dataset: one tree per source, one tree over their roots.

A level of all trees is one table. Every node computes the places of its siblings (its own index XOR 1 in a binary
tree, otherwise every other slot of its run) and finds each of them by an equijoin of the level with itself; the nodes
in slot zero, which have all their siblings to the right, then emit the parents. Nodes below keep what
stands left and right of them, so the way from a leaf to the root is the chain of these pairs: it is handed down
level by level, each parent to its children, and proofs and checks are folds over it inside one row.

The driver learns only the size of the largest tree, which gives the number of levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import keep, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
_WAY = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    """The leaf of a document row; ``replaced`` gives fields another value."""
    return digest(*[field(replaced.get(c, F.col(c))) for c in FIELDS])


def tree_name(source: Column) -> Column:
    """Key of a source that is never null and sorts as null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``, the digests of the node's run before and after it, joined as text. ``level`` is a
    written table with (tree, at, digest) and other columns."""
    slot, found, names = F.expr(f"at % {arity}"), level, []
    for step in range(1, arity):
        place = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + F.expr(f"(at + {step}) % {arity}")
        other = level.select(F.col("tree").alias("_tree"), F.col("at").alias(f"at_{step}"), F.col("digest").alias(f"digest_{step}"))
        found = found.withColumn("_place", place).join(
            other, (F.col("tree") == F.col("_tree")) & (F.col("_place") == F.col(f"at_{step}")), "left").drop("_tree", "_place")
        names += [f"at_{step}", f"digest_{step}"]
    others = F.array_sort(F.array(*[F.when(F.col(f"at_{k}").isNotNull(), F.struct(F.col(f"at_{k}").alias("at"), F.col(f"digest_{k}").alias("digest")))
                                    for k in range(1, arity)]))

    def side(keeps) -> Column:
        return F.array_join(F.transform(F.filter(others, keeps), lambda o: o["digest"]), "")

    return found.select(*level.columns, side(lambda o: o["at"] < F.col("at")).alias("left"), side(lambda o: o["at"] > F.col("at")).alias("right"))


def grow(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """All levels of all trees from written ``leaves`` (tree, at from 0 without gaps, size of the tree, digest, other
    columns): the levels with ``left`` and ``right``, and (tree, digest) of the roots. A tree of one node is its own root."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, roots, level = [], [], leaves
    while largest > 1:
        paired = keep(with_siblings(level.filter("size > 1"), arity), "merkle-level")
        roots.append(level.filter("size = 1").select("tree", "digest"))
        levels.append(paired)
        up = paired.filter(f"at % {arity} = 0").select(
            "tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
            digest(F.col("digest"), F.col("right")).alias("digest"))
        level, largest = keep(up, "merkle-parents"), (largest + arity - 1) // arity
    roots.append(level.select("tree", "digest"))
    return levels, reduce(DataFrame.unionAll, roots)


def ways(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes of the lowest level that have a sibling level, each with ``way``, its siblings level by level up to
    what ``tops`` (tree, way, other columns) says of its tree's root, and the other columns of ``tops``."""
    extra = [c for c in tops.columns if c not in ("tree", "way")]
    above = None
    for level in reversed(levels):
        pair = F.array(F.struct("left", "right"))
        last = level.filter(f"size <= {arity}").join(tops, "tree")  # their parent is the root
        nodes = last.select(*level.columns, *extra, F.concat(pair, "way").alias("way"))
        if above is not None:
            parents = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "way", *extra)
            inner = level.filter(f"size > {arity}").join(parents, (F.col("tree") == F.col("_tree")) & (F.expr(f"at div {arity}") == F.col("_at")))
            nodes = nodes.unionAll(inner.select(*level.columns, *extra, F.concat(pair, "way").alias("way")))
        above = keep(nodes, "merkle-ways")
    return above


def fold(start: Column, way: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(way, start, lambda node, s: digest(s["left"], node, s["right"]))


def proof(way: Column) -> Column:
    """Digest of all siblings from the leaf to the root, left to right; of nothing when there are none."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, altered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored): doc_id, source,
    leaf, altered (leaf of the row with ``altered`` for its text, null where that changes nothing or is null), subroot,
    root, way.

    Within a source, null being one of its own, leaves ascend by doc_id, null first; rows that share one ascend by leaf.
    Rows alike in all fields are leaves as often as they occur. Every field may be null or of any length. An
    empty table gives no rows. Only digests are shuffled, never texts, and a source of any size is spread over all
    tasks, by rank within it."""
    mine = leaf()
    theirs = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(text=altered))
    rows = docs.select(tree_name(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), mine.alias("digest"), theirs.alias("altered"))
    leaves = numbered(rows, "tree", ("doc_id", "digest"))
    levels, roots = grow(leaves, arity)

    subroots = numbered(keep(roots.select(F.lit("").alias("top"), "tree", "digest"), "subroots"), "top", ("tree",))
    named = subroots.select(F.col("top").alias("tree"), "at", "size", "digest", F.col("tree").alias("name"))
    upper, root = grow(keep(named, "subroots"), arity)
    top = root.select("tree", F.col("digest").alias("root"), F.array().cast(_WAY).alias("way"))
    alone = named.filter("size = 1").join(F.broadcast(top), "tree")  # one row
    tops = alone if not upper else ways(upper, top, arity)
    tops = keep(tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "way"), "tops")

    wanted = ("tree", "doc_id", "digest", "altered", "subroot", "root", "way")
    every = leaves.filter("size = 1").join(tops, "tree").select(*wanted)
    if levels:
        every = every.unionAll(ways(levels, tops, arity).select(*wanted))
    source = F.when(F.col("tree") != "n", F.expr("substring(tree, 2)"))
    return every.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), "altered", "subroot", "root", "way")


def verified(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with proof_sha256, folded_root (of the altered leaf where there is one) and verified."""
    again = rows.withColumn("proof_sha256", proof(F.col("way"))).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("way")))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))
