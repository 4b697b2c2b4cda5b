"""Embedding near-duplicates by a forest of random-projection trees.

Directions (unit vectors) of one label and length go down several trees. A node draws a few random directions, keeps
the one and the cut that part its vectors best, and sends those within a band around the cut to both sides
(spill). The band is a distance: two vectors as far apart as the cosine allows differ on a random direction by
their distance over the root of the dimensions, times a normal variable; the band is ``BAND`` of that. So a node
whose vectors lie close together hardly shrinks by splitting: it is not split any further and, like the
small nodes where a tree ends, compared exactly, pair by pair of blocks of bounded size, one task each.

A pair that shares several leaves is counted in the smallest of them only, so links need no list of pairs: a leaf
returns sums and the edges of its components, both linear in its vectors. Nodes are settled several levels at a
time on a bounded sample of their vectors, and all their vectors are routed by it, at every size in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import components, keep, slots

COSINE = 0.93
LEAF_ROWS = 128       # where a tree ends
TREES = 6
BAND = 0.7
SHRINK = 0.6          # a node of which no cut leaves at most this share on either side is compared as it is
CANDIDATES = 4        # random directions a node chooses from
CUTS = (0.35, 0.5, 0.65)
LEVELS = 8            # levels of a tree settled by one sample
SAMPLE_ROWS = 4096
FEWEST = 48           # a node with fewer sampled vectors is sampled anew before it is split
ROUNDS = 12           # after these, what is left is compared as it is
ROUTE_ROWS = 8192     # vectors of a node that one task sends on
BLOCK_ROWS = 4096     # vectors of a leaf that one task compares with each other, or with as many others
_LEAF, _OPEN = 0, 1
_KEYS = ("label", "dims", "tree", "node")
_ROUTED = "label int, dims int, tree int, node bigint, rep bigint, unit binary, open int"


def _directions(tree: int, node: int, k: int, dims: int) -> np.ndarray:
    """The random unit directions of node ``k`` below a settled node."""
    drawn = np.random.default_rng([int(tree), int(node), int(k), int(dims)]).normal(size=(CANDIDATES, dims))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def half_band(cosine: float, dims: int, band: float) -> float:
    """Half the width within which both sides of a cut get a vector; with half the distance itself no pair is lost."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    return float(min(reach, band * reach / np.sqrt(dims)) / 2)


def _units(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, vector, usable) of every row; usable are those with a label and a finite vector that is
    not zero."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    fine = F.col("label").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    return rows.select("vec_id", "label", F.size("vector").alias("dims"), "vector", fine.alias("usable"))


def _with_units(rows: DataFrame) -> DataFrame:
    """Replace ``vector`` by the bytes of its unit vector and add ``key``, equal for vectors of one direction; scaled by
    the largest component first, so that no square over- or underflows."""
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, keys = [], []
            for v in batch.column(at):
                x = v.values.to_numpy(zero_copy_only=False)
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
                units.append(x.tobytes())
                keys.append(blake2b(np.rint(x * 2.0 ** 44).astype(np.int64).tobytes(), digest_size=16).digest())
            columns = list(batch.columns)
            columns[at] = pa.array(units, pa.binary())
            names = [*batch.schema.names[:at], "unit", *batch.schema.names[at + 1:], "key"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary())], names)

    fields = [f"{c} {t}" if c != "vector" else "unit binary" for c, t in rows.dtypes]
    return rows.mapInArrow(run, ", ".join([*fields, "key binary"]))


def grow(x: np.ndarray, n: int, tree: int, node: int, half: float, leaf_rows: int) -> tuple[list[int], list[float], list[int]]:
    """Settle the next levels of a node of ``n`` vectors on a sample of their units: per place (children of k at 2k + 1 and
    2k + 2) the chosen direction or -1 where the node ends, the cut, and whether an ended node is still open."""
    size = (1 << (LEVELS + 1)) - 1
    chosen, cut, is_open = [-1] * size, [0.0] * size, [_LEAF] * size
    members = {0: np.arange(len(x))}
    for k in range(size):
        mine = members.pop(k, None)
        if mine is None or n * len(mine) / len(x) <= leaf_rows:
            continue
        if k >= size // 2 or (k and len(mine) < FEWEST):
            is_open[k] = _OPEN
            continue
        shown = x[mine] @ _directions(tree, node, k, x.shape[1]).T
        best = (SHRINK, -1, 0.0)
        for c in range(CANDIDATES):
            for at in np.quantile(shown[:, c], CUTS):
                share = max(np.mean(shown[:, c] <= at + half), np.mean(shown[:, c] > at - half))
                best = min(best, (share, c, float(at)))
        if best[1] >= 0:
            _, chosen[k], cut[k] = best
            side = shown[:, chosen[k]]
            members[2 * k + 1], members[2 * k + 2] = mine[side <= cut[k] + half], mine[side > cut[k] - half]
    return chosen, cut, is_open


def send(x: np.ndarray, tree: int, node: int, half: float, chosen: list[int], cut: list[float]) -> dict[int, np.ndarray]:
    """Rows of every place where they end, a row in all the places it spills to."""
    at, ended = {0: np.arange(len(x))}, {}
    for k in range(len(chosen)):
        mine = at.pop(k, None)
        if mine is None or not len(mine):
            continue
        if chosen[k] < 0:
            ended[k] = mine
            continue
        side = x[mine] @ _directions(tree, node, k, x.shape[1])[chosen[k]]
        at[2 * k + 1], at[2 * k + 2] = mine[side <= cut[k] + half], mine[side > cut[k] - half]
    return ended


def _split(active: DataFrame, cosine: float, band: float, leaf_rows: int, sample_rows: int) -> DataFrame:
    """One round: settle the next levels of every open node on its sample and route all its rows, some thousands of a node
    in a task. The unit travels on only with rows whose node stays open."""
    schema = pa.schema([("label", pa.int32()), ("dims", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("rep", pa.int64()),
                        ("unit", pa.binary()), ("open", pa.int32())])
    many = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")

    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        label, dims, tree, node = key
        x, n = _units(sample.sort_values("rep")["unit"], dims), int(sample["n"].iloc[0])
        grown = grow(x, n, tree, node, half_band(cosine, dims, band), leaf_rows)
        return pd.DataFrame([(label, dims, tree, node, n, *grown)], columns=[*_KEYS, "n", "chosen", "cut", "opens"])

    share = F.pmod(F.xxhash64("rep", "tree", "node"), F.lit(1 << 20)) < F.lit(float(sample_rows << 20)) / F.col("n")
    fitted = keep(active.filter(share).groupBy(*_KEYS).applyInPandas(
        fit, "label int, dims int, tree int, node bigint, n bigint, chosen array<int>, cut array<double>, opens array<int>"), "splits")

    def route(key: tuple, rows: pa.Table, splits: pa.Table) -> pa.Table:
        label, dims, tree, node, _ = (k.as_py() for k in key)
        chosen, cut, opens = (splits.column(c)[0].as_py() for c in ("chosen", "cut", "opens"))
        units = rows.column("unit").to_pylist()
        ended = send(_units(units, dims), tree, node, half_band(cosine, dims, band), chosen, cut)
        at, sizes = np.concatenate(list(ended.values())), list(map(len, ended.values()))
        child = np.repeat(np.array([(node * 1_000_003 + k + 1) % (1 << 62) for k in ended], np.int64), sizes)
        still = np.repeat(np.array([opens[k] for k in ended], np.int32), sizes)
        kept = pa.array([units[i] if s else None for i, s in zip(at.tolist(), still.tolist())], pa.binary())
        fixed = [pa.array(np.full(len(at), v, np.int32)) for v in (label, dims, tree)]
        return pa.Table.from_arrays([*fixed, pa.array(child), rows.column("rep").combine_chunks().take(pa.array(at)), kept, pa.array(still)], schema=schema)

    salted = active.withColumn("salt", F.pmod(F.xxhash64("rep"), many).cast("int")).drop("n")
    given = fitted.select(*_KEYS, "chosen", "cut", "opens", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"))
    keys = [*_KEYS, "salt"]
    return salted.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(route, _ROUTED)


def leaves(base: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS, trees: int = TREES, band: float = BAND,
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, dims, rep, leaf): the leaves of every direction of ``base`` (rep, label, dims, unit) in all trees. A label
    of at most ``leaf_rows`` directions is a leaf itself, the root of every tree."""
    code = F.xxhash64("label", "dims", "tree", "node").alias("leaf")
    sized = base.join(keep(base.groupBy("label", "dims").agg(F.count("*").alias("n")), "labels"), ["label", "dims"])
    many = F.when(F.col("n") > leaf_rows, F.sequence(F.lit(0), F.lit(trees - 1))).otherwise(F.array(F.lit(0)))
    rooted = sized.select("label", "dims", F.explode(many).alias("tree"), F.lit(0).cast("bigint").alias("node"), "rep", "unit", "n")
    done = [rooted.filter(F.col("n") <= leaf_rows).select("label", "dims", "rep", code)]
    active = rooted.filter(F.col("n") > leaf_rows)
    for step in range(ROUNDS):
        if active.isEmpty():
            break
        routed = keep(_split(active, cosine, band, leaf_rows, sample_rows), "routed")
        ended = routed if step == ROUNDS - 1 else routed.filter(F.col("open") == _LEAF)
        done.append(ended.select("label", "dims", "rep", code))
        still = routed.filter(F.col("open") == _OPEN).drop("open")
        active = still.join(keep(still.groupBy(*_KEYS).agg(F.count("*").alias("n")), "nodes"), list(_KEYS))
    return reduce(DataFrame.unionAll, done)


def _shared_earlier(rows: list[np.ndarray], others: list[np.ndarray] | None, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Membership of rows and others in the leaves that both know, some leaves at a time so that memory is bounded."""
    sides = [rows] if others is None else [rows, others]
    flat = [np.concatenate([*side, np.empty(0, np.int64)]) for side in sides]
    owner = [np.repeat(np.arange(len(side)), list(map(len, side))) for side in sides]
    codes = np.unique(flat[0])
    if others is None:
        codes = codes[np.bincount(np.searchsorted(codes, flat[0]), minlength=len(codes)) > 1]
    else:
        codes = np.intersect1d(codes, flat[1])
    for at in range(0, len(codes), step):
        part, out = codes[at:at + step], []
        for side, held, who in zip(sides, flat, owner):
            place = np.minimum(np.searchsorted(part, held), len(part) - 1)
            known = part[place] == held
            member = np.zeros((len(side), len(part)), np.float32)
            member[who[known], place[known]] = 1
            out.append(member)
        yield out[0], out[-1]


def compare_block(rep: np.ndarray, copies: np.ndarray, units: np.ndarray, earlier: list[np.ndarray], cosine: float, first: int | None = None,
                  block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links of every vector that no smaller shared leaf has counted, weighted by copies, and the component of every
    vector among them (as the smallest rep). With ``first`` only pairs of one of the first ``first`` rows and
    one of the others count; the rest belong to other blocks."""
    n, split = len(rep), len(rep) if first is None else first
    others = np.arange(n) if first is None else np.arange(first, n)
    links, near = np.zeros(n, np.int64), np.zeros((n, (n + 7) // 8), np.uint8)
    shared = list(_shared_earlier(earlier[:split], None if first is None else earlier[first:]))
    for a in range(0, split, block):
        b = min(split, a + block)
        close = units[a:b] @ units[others].T >= cosine
        if first is None:
            close[np.arange(b - a), np.arange(a, b)] = False
        new = close
        for left, right in shared:
            new = new & (left[a:b] @ right.T == 0)
        links[a:b] += new @ copies[others]
        if first is not None:
            links[others] += copies[a:b] @ new
        wide = np.zeros((b - a, n), bool)
        wide[:, others] = close
        near[a:b] |= np.packbits(wide, axis=1)
    if first is not None:  # the other direction of the same pairs
        for a in range(first, n, block):
            b = min(n, a + block)
            rows = np.unpackbits(near[:first], axis=1, count=n)[:, a:b]
            near[a:b, :(first + 7) // 8] |= np.packbits(rows.T, axis=1)
    label = np.full(n, -1)
    for start in np.argsort(rep, kind="stable"):
        if label[start] < 0:
            label[start], front = start, np.array([start])
            while len(front):
                reached = np.unpackbits(np.bitwise_or.reduce(near[front], axis=0), count=n).astype(bool)
                front = np.flatnonzero(reached & (label < 0))
                label[front] = start
    return links, rep[label]


def in_blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """(label, dims, rep, leaf, low, high, second): the pairs of blocks of its leaves that a direction takes part in, and
    whether it stands in the second block of the pair. A leaf of at most ``block_rows`` is one block."""
    sizes = keep(placed.groupBy("label", "dims", "leaf").agg(F.count("*").alias("n")), "leaf-sizes")
    many = F.ceil(F.col("n") / block_rows).cast("int")
    sized = placed.join(sizes, ["label", "dims", "leaf"]).select("label", "dims", "rep", "leaf", many.alias("many"),
                                                                 F.pmod(F.xxhash64("rep", "leaf"), many).cast("int").alias("mine"))
    other = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
    return other.select("label", "dims", "rep", "leaf", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
                        (F.col("mine") > F.col("other")).alias("second"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS, trees: int = TREES, band: float = BAND,
                    sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label; other columns are ignored): vec_id, n_links,
    component_id, kept.

    Vectors are compared when labels are equal and not null and lengths are equal. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing. Vectors of one direction become one before the
    trees are built and count as linked to each other. component_id is the smallest vec_id
    reachable; a null vec_id is never the smallest unless there is no other. An empty table gives no rows."""
    every = keep(usable(vectors), "vectors")
    good = keep(_with_units(every.filter("usable").drop("usable")), "units")
    base = good.groupBy("label", "dims", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("unit").alias("unit"))
    base = keep(base.withColumn("rep", F.monotonically_increasing_id()), "base")  # written once, so stable
    placed = keep(leaves(base.select("label", "dims", "rep", "unit"), cosine, leaf_rows, trees, band, sample_rows), "leaves")
    # at most trees times the spilled leaves of a tree
    all_leaves = keep(placed.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")), "leaf-lists")
    paired = in_blocks(placed, block_rows).join(all_leaves, "rep")
    rows = paired.join(base.select("rep", "copies", "unit"), "rep").select(
        "label", "dims", "leaf", "low", "high", "second", "rep", "copies", "unit", F.filter("leaves", lambda c: c < F.col("leaf")).alias("earlier"))

    def compare(key: tuple, leaf: pd.DataFrame) -> pd.DataFrame:
        _, dims, _, low, high = key
        leaf = leaf.sort_values("second", kind="stable") if low != high else leaf
        rep, first = leaf["rep"].to_numpy(), None if low == high else int((~leaf["second"]).sum())
        earlier = [np.asarray(e, np.int64) for e in leaf["earlier"]]
        links, label = compare_block(rep, leaf["copies"].to_numpy(), _units(leaf["unit"], dims), earlier, cosine, first)
        return pd.DataFrame({"rep": rep, "links": links, "label": label})[(links > 0) | (rep != label)]

    group = ("label", "dims", "leaf", "low", "high")
    spread = rows.repartition(slots(vectors.sparkSession), *group)
    compared = keep(spread.groupBy(*group).applyInPandas(compare, "rep bigint, links bigint, label bigint"), "compared")
    counts = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    members = base.select("rep", "label", "dims", "key", "copies", "least").join(counts, "rep", "left").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left")
    members = keep(members.select("label", "dims", "key", "least", F.coalesce("component", "rep").alias("component"),
                                  (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
    smallest = keep(members.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    found = keep(members.join(smallest, "component").select("label", "dims", "key", "n_links", "component_id"), "found")
    linked = good.join(found, ["label", "dims", "key"]).select("vec_id", "n_links", "component_id")
    rest = every.filter("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
