"""Projection forest against all pairs."""

import numpy as np
import pytest

from drawstat.llm import embedding_forest as forest
from tests.llm.test_simhash import plain_components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    good = {}
    for i, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = (label, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    near = {(a, b) for a in good for b in good if a != b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1])
            and good[a][1] @ good[b][1] >= cosine}
    component = plain_components([r[0] for r in rows], lambda a, b: (a, b) in near)
    return {i: (sum(a == i for a, _ in near), component[i]) for i, _, _ in rows}


def vectors(n, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 4)) if k else 40):
            rows.append((base + rng.normal(size=dims) * 0.12 * rng.random(), int(k % 2)))
    rows += [(rows[5][0], rows[5][1])] * 20
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in rows[j][0]], rows[j][1]) for i, j in enumerate(order)]


def test_one_leaf_is_exact(spark):
    rows = vectors(60)
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [3e38, 0.0], [1e-38, 0.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], 77)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", rep int")
    found = forest.near_duplicates(frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows) and len(found) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def measured(spark, rows, **options):
    """Share of the true link ends that are counted, after checking that nothing else is."""
    expected = true_links(rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert len(found) == len(rows) and all(found[i][0] <= n for i, n in expected.items())
    return sum(v[0] for v in found.values()) / max(1, sum(expected.values())), found


def true_links(rows, cosine=forest.COSINE):
    out = {}
    for label in {r[2] for r in rows}:
        mine = [(i, v) for i, v, k in rows if k == label]
        x = np.array([v for _, v in mine], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for at in range(0, len(x), 1000):
            out |= dict(zip([i for i, _ in mine[at:at + 1000]], ((x[at:at + 1000] @ x.T >= cosine).sum(axis=1) - 1).tolist()))
    return out


def shaped(kind, n, dims=64, seed=7):
    """A label of ``n`` directions with near pairs just above the threshold."""
    rng = np.random.default_rng(seed)
    centre = {"isotropic": 0.0, "concentrated": 2.0}[kind] * rng.normal(size=dims)
    x = centre + rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(n // 4, dims))
    near = x[:n // 4]
    other -= (other * near).sum(axis=1, keepdims=True) * near
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    angle = rng.uniform(0.931, 0.95, size=(n // 4, 1))
    return np.concatenate([x, near * angle + other * np.sqrt(1 - angle ** 2)])


@pytest.mark.parametrize("kind", ["isotropic", "concentrated"])
def test_recall_at_the_default_settings(spark, kind):
    """Labels of thousands of directions, which the default settings really split."""
    rows = [(i, x.tolist(), 1) for i, x in enumerate(shaped(kind, 6000))]
    recall, found = measured(spark, rows)
    assert recall >= 0.98


def test_dense_clusters_at_the_default_settings(spark):
    """Clusters of several leaves among random directions: 1,500 near copies of one and 5,000 of another."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8000, 64))
    for low, high in ((0, 1500), (1500, 6500)):
        x[low:high] = x[low] + 0.1 * rng.normal(size=(high - low, 64))
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x[rng.permutation(len(x))])]
    recall, found = measured(spark, rows)
    assert recall >= 0.999
    assert sorted(np.unique([c for _, c in found.values()], return_counts=True)[1].tolist())[-2:] == [1500, 5000]


def test_split_forest_on_few_dimensions(spark):
    rows = vectors(500, seed=2)
    recall, found = measured(spark, rows, leaf_rows=40, sample_rows=200)
    assert recall >= 0.98
    expected = brute(rows)
    assert all(expected[i][1] <= found[i][1] for i in expected)  # a component is never larger than the true one


def test_multiples_of_one_vector_are_one_direction(spark):
    rows = [(i, [float((i + 1) * v) for v in (0.3, -1.5, 2.25, 0.1)], 1) for i in range(300)] + [(900, [1.0, 0.0, 0.0, 0.0], 1)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf_rows=20).collect()}
    assert found == {**{i: (299, 0) for i in range(300)}, 900: (0, 900)}


def test_blocks_equal_one_leaf(spark):
    rows = vectors(60, seed=5)
    whole = forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf_rows=10_000).collect()
    parts = forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf_rows=10_000, block_rows=16).collect()
    assert sorted(whole) == sorted(parts)


def test_blocks_share_the_pairs():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(60, 5))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rep, copies, earlier = rng.permutation(60), rng.integers(1, 4, 60), [rng.choice(8, 1) for _ in range(60)]
    links, _ = forest.compare_block(rep, copies, units, earlier, 0.8, first=23, block=7)
    close = (units @ units.T >= 0.8) & np.array([[(i < 23) != (j < 23) for j in range(60)] for i in range(60)])
    new = close & np.array([[not set(a) & set(b) for b in earlier] for a in earlier])
    assert links.tolist() == (new @ copies).tolist()
    _, label = forest.compare_block(rep, copies, units, earlier, 0.8, first=23, block=7)
    component = plain_components(list(range(60)), lambda a, b: bool(close[a, b]))
    groups = lambda of: sorted(sorted(i for i in range(60) if of(i) == g) for g in {of(i) for i in range(60)})
    assert groups(lambda i: label[i]) == groups(lambda i: component[i])


def test_leaves_count_shared_pairs_once():
    units = np.array([[1.0, 0], [1, 0], [0, 1]])
    links, label = forest.compare_block(np.array([7, 3, 9]), np.array([1, 2, 1]), units, [np.array([5])] * 3, 0.9)
    assert links.tolist() == [0, 0, 0] and label.tolist() == [3, 3, 9]
    links, _ = forest.compare_block(np.array([7, 3, 9]), np.array([1, 2, 1]), units, [np.array([5]), np.array([6]), np.empty(0, int)], 0.9)
    assert links.tolist() == [2, 1, 0]


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    rows = spark.createDataFrame([(4, [1.0, 2.0], 1)][:n], SCHEMA)
    assert [tuple(r) for r in forest.near_duplicates(rows).collect()] == [(4, 0, 4, True)][:n]


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [2.0, -1.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in forest.near_duplicates(rows).collect()) == [
        ("4", 0, 4), ("4", 2, 4), ("4", 2, 4), ("None", 2, 4)]
