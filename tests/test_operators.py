from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawstat.functions.prng import uniforms_at, xorshift_step
from drawstat.operators import backtest as bt
from drawstat.operators import draws as dr
from drawstat.operators import frequency as fq
from drawstat.operators import ledger as lg
from drawstat.operators import montecarlo as mc
from drawstat.operators import stats as st
from drawstat.operators.shifts import shift_list, shifted_totals
from drawstat.operators.tickets import capped_tickets
from drawstat.plans import experiments as ex
from drawstat.settings import SINGLE_GAME, WHEEL_GAME, Game
from drawstat.sources.sinks import overwrite_json
from tests import reference_forms as rf

RAW = "source string, source_ord bigint, draw_date date, numbers array<int>, bonus int"
D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
A, B = [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7]


def test_first_and_last_win_with_conflicts(spark):
    raw = spark.createDataFrame([("x", 2, D1, B, 9), ("x", 1, D1, A, 9), ("x", 3, D2, A, 8), ("y", 4, D2, A, 9)], RAW)
    first = {r["draw_date"]: r for r in dr.dedup_by_date(raw, "first").collect()}
    last = {r["draw_date"]: r for r in dr.dedup_by_date(raw, "last", compare=("numbers",)).collect()}
    assert first[D1]["numbers"] == A and last[D1]["numbers"] == B and first[D1]["conflict"] and last[D1]["conflict"]
    assert first[D2]["conflict"] and not last[D2]["conflict"]  # bonus differs only
    with pytest.raises(dr.DataError):
        dr.require_no_conflict(dr.dedup_by_date(raw))
    summary = dr.coverage(dr.dedup_by_date(raw)).first()
    assert (summary["draws"], summary["raw_rows"], summary["duplicate_rows"], summary["conflicting_dates"]) == (2, 4, 2, 2)


def test_hot_date_is_combined(spark):
    rows = spark.range(20000).select(
        F.lit("x").alias("source"), F.col("id").alias("source_ord"), F.lit(D1).alias("draw_date"),
        F.array(*map(F.lit, A)).alias("numbers"), F.lit(9).alias("bonus"))
    row = dr.dedup_by_date(rows).first()
    assert (row["n_rows"], row["conflict"], row["source_ord"]) == (20000, False, 0)


def test_validation_raises_with_counts(spark):
    raw = spark.createDataFrame([("x", 1, D1, A, 9), ("x", 2, D2, [1, 1, 2, 3, 4, 5], 9), ("x", 3, D2, A, 6)], RAW)
    checked = dr.with_violations(raw, SINGLE_GAME)
    assert {r["violation"]: r["n_rows"] for r in dr.violation_counts(checked).collect()} == {"any": 2, "numbers": 1, "bonus": 1}
    with pytest.raises(dr.DataError):
        dr.require_valid(checked)
    assert dr.require_valid(checked.filter("source_ord = 1")).count() == 1
    with pytest.raises(dr.DataError):
        ex.prepared(raw.filter("source_ord = 1"))  # a single draw is not enough


def test_capped_ticket_of_equal_scores(spark):
    grid = spark.range(1, 91).select(F.lit("s").alias("series"), F.lit(0).alias("draw_idx"), F.lit(D1).alias("draw_date"),
                                     F.col("id").cast("int").alias("number"), F.lit(0).alias("hit"), F.lit(1.0).alias("flat"))
    assert capped_tickets(grid, ["flat"], SINGLE_GAME).first()["flat_ticket"] == [1, 2, 3, 11, 12, 13]


def test_walk_forward_equals_brute_force(make_draws):
    draws = rf.random_draws(230)
    rows = bt.walk_forward(make_draws(draws), SINGLE_GAME).orderBy("draw_idx").collect()
    assert [r["draw_idx"] for r in rows] == list(range(208, 230))
    for r in rows:
        i = r["draw_idx"]
        assert r["integrated_ticket"] == rf.horizon_ticket(draws[:i]) and r["actual"] == draws[i]
        assert r["frequency52_ticket"] == rf.trailing_ticket(draws[:i], 52)
        assert r["integrated_hits"] == len(set(r["integrated_ticket"]) & set(draws[i]))
    upcoming = bt.next_tickets(make_draws(draws), SINGLE_GAME).first()
    assert upcoming["integrated_ticket"] == rf.horizon_ticket(draws)
    assert upcoming["frequency52_ticket"] == rf.trailing_ticket(draws, 52)


def test_whole_experiment_from_raw_rows(spark, tmp_path):
    draws = rf.random_draws(215, seed=12)
    start = date(2023, 1, 1)
    rows = [("x", i, start + timedelta(days=i), d, next(n for n in range(1, 91) if n not in d)) for i, d in enumerate(draws)]
    raw = spark.createDataFrame(rows + rows[:3], RAW)
    last = start + timedelta(days=214)
    indexed = ex.prepared(raw, first_date=start, last_date=last, draws=215, duplicate_rows=3)
    document = ex.walk_forward_document(indexed)
    overwrite_json(document, str(tmp_path / "experiment"))
    saved = spark.read.json(str(tmp_path / "experiment")).first()
    assert saved["coverage"]["draws"] == 215 and saved["evaluation"]["testedDraws"] == 7 and len(saved["rows"]) == 7
    assert saved["nextPrediction"] == rf.horizon_ticket(draws) and saved["rows"][0]["integrated_ticket"] == rf.horizon_ticket(draws[:208])
    assert {m["method"] for m in saved["methods"]} == {"integrated", "frequency52", "random"}
    with pytest.raises(dr.DataError, match="coverage"):
        ex.prepared(raw, duplicate_rows=0)


def test_short_history_has_no_backtest(make_draws):
    indexed = make_draws(rf.random_draws(207))
    assert bt.walk_forward(indexed, SINGLE_GAME).count() == 0
    assert bt.next_tickets(indexed, SINGLE_GAME).count() == 0


MODELS = {"one": ("MoonPhase",), "two": ("Sun", "Mars")}


def featured(make_draws, draws, bins):
    spark_rows = make_draws(draws)
    table = spark_rows.sparkSession.createDataFrame(
        [(i, *b) for i, b in enumerate(bins)], "draw_idx int, MoonPhase int, Sun int, Mars int")
    return spark_rows.join(table, "draw_idx")


def test_binned_backtest_equals_brute_force_and_kernel(make_draws):
    n, window, game = 60, 20, Game(pick=5)
    draws = rf.random_draws(n, pick=5, seed=3)
    rng = np.random.default_rng(5)
    bins = [tuple(int(x) for x in rng.integers(0, 3, 3)) for _ in range(n)]
    names = {"MoonPhase": 0, "Sun": 1, "Mars": 2}
    table = featured(make_draws, draws, bins)
    rows = bt.binned_backtest(table, game, MODELS, window, 30).orderBy("draw_idx").collect()
    assert [r["draw_idx"] for r in rows] == list(range(window, n))
    for r in rows:
        i = r["draw_idx"]
        for model, features in MODELS.items():
            assert r[f"{model}_ticket"] == rf.binned_ticket(draws, bins, i, [names[f] for f in features], window, 30, 5)
        assert r["frequency_ticket"] == rf.trailing_ticket(draws[:i], window, 5)
    totals = {(r["shift"], r["model"]): r["total_hits"] for r in shifted_totals(table, game, 6, 7, True, MODELS, window).collect()}
    for shift in {s for s, _ in totals}:
        moved = [bins[(i + shift) % n] for i in range(n)]
        for model, features in MODELS.items():
            expected = sum(len(set(rf.binned_ticket(draws, moved, i, [names[f] for f in features], window, 30, 5)) & set(draws[i]))
                           for i in range(window, n))
            assert totals[shift, model] == expected
    shift = max(s for s, _ in totals)
    rotated = bt.binned_backtest(bt.rotate_features(table, shift, tuple(names)), game, MODELS, window, 30)
    sums = rotated.agg(*[F.sum(f"{m}_hits").alias(m) for m in MODELS]).first()
    assert all(sums[m] == totals[shift, m] for m in MODELS)


def test_changing_the_outcome_keeps_its_prediction(make_draws):
    same = [[1, 2, 3, 11, 12, 13]] * 3
    changed = same[:2] + [[80, 81, 82, 83, 84, 85]]
    results = []
    for draws in (same, changed):
        table = featured(make_draws, draws, [(0, 0, 0)] * 3)
        results.append(bt.binned_backtest(table, SINGLE_GAME, {"m": ("MoonPhase",)}, 2, 30).first())
    assert results[0]["m_ticket"] == results[1]["m_ticket"]
    assert (results[0]["m_hits"], results[1]["m_hits"]) == (6, 0)


def test_a_cap_without_enough_numbers_stops_the_job(make_draws):
    """Two decades of three with one number each cannot fill a ticket of five."""
    game = Game(pool=6, pick=5, cap=1, decade=3)
    rows = make_draws([[1, 2, 3, 4, 5]] * 4)
    with pytest.raises(Exception, match="no ticket satisfies the cap"):
        bt.walk_forward(rows, game, warmup=2).collect()


def test_bins_outside_the_bitmaps_stop_the_job(make_draws):
    table = featured(make_draws, [[1, 2, 3, 11, 12, 13]] * 4, [(0, 0, 0)] * 3 + [(12, 0, 0)])
    with pytest.raises(Exception, match="no bin of"):
        bt.binned_backtest(table, SINGLE_GAME, {"m": ("MoonPhase",)}, 2, 30).collect()


def test_masks_equal_arrays(spark):
    """Dedup of rows with arrays, regular or not, and with texts, against a plain loop."""
    rng = np.random.default_rng(3)
    pools = [[1, 2, 3], [3, 2, 1], [1, 1, 2], [45, 46, 90], [], [0, 5], [91], [1, None], None]
    rows = [(int(rng.integers(6)), str(rng.integers(3)) if i % 5 else None, i, pools[int(rng.integers(len(pools)))], int(rng.integers(3)) if i % 4 else None)
            for i in rng.permutation(300).tolist()]
    frame = spark.createDataFrame(rows, "draw_date int, source string, source_ord bigint, numbers array<int>, bonus int").repartition(5)
    for keep, best in (("first", min), ("last", max)):
        for compare, part in ((("numbers", "bonus"), lambda r: (str(r[3]), r[4])), (("numbers",), lambda r: str(r[3]))):
            found = {r["draw_date"]: r for r in dr.dedup_by_date(frame, keep, compare).collect()}
            for key in {r[0] for r in rows}:
                mine = [r for r in rows if r[0] == key]
                kept = best(mine, key=lambda r: r[2])
                assert tuple(found[key][c] for c in ("source", "source_ord", "numbers", "bonus", "n_rows")) == (*kept[1:], len(mine))
                assert found[key]["conflict"] == (len({part(r) for r in mine}) > 1)
    one = spark.createDataFrame([(1, 1, [3, 2, 1], 4), (1, 2, [1, 2, 3], 4)], "draw_date int, source_ord bigint, numbers array<int>, bonus int")
    assert dr.dedup_by_date(one).first()["conflict"]


def test_saved_tickets_meet_the_next_draw(spark):
    tickets = [("s", "m", date(2024, 1, d), [1, 2, d]) for d in (1, 3, 3, 9)] + [("t", "m", date(2024, 1, 1), [7])]
    draws = [("s", date(2024, 1, 3), [1, 2, 3]), ("s", date(2024, 1, 5), [1, 8, 9])]
    found = bt.match_next(spark.createDataFrame(tickets, "series string, method string, saved_on date, ticket array<int>"),
                          spark.createDataFrame(draws, "series string, draw_date date, numbers array<int>")).collect()
    assert sorted((r["series"], r["saved_on"].day, r["draw_date"] and r["draw_date"].day, r["hit_count"]) for r in found if r["draw_date"]) == [
        ("s", 1, 3, 2), ("s", 3, 5, 1), ("s", 3, 5, 1)]
    assert sorted((r["series"], r["hit_count"]) for r in found if r["draw_date"] is None) == [("s", None), ("t", None)]


def test_shift_lists(spark):
    sizes = spark.createDataFrame([(210,)], "n int")
    distinct = sizes.select(shift_list(F.col("n"), 199, 20261002, True)).first()[0]
    assert len(distinct) == len(set(distinct)) == 199 and min(distinct) >= 1 and max(distinct) <= 209
    free = sizes.select(shift_list(F.col("n"), 99, 20261003, False)).first()[0]
    assert free == (1 + np.floor(uniforms_at(20261003, np.arange(99)) * 209)).astype(int).tolist()
    # a series too short for that many shifts has none and stops nothing
    short = spark.createDataFrame([(100,), (1,), (300,)], "n int").select("n", shift_list(F.col("n"), 199, 1, True).alias("s")).collect()
    assert {r["n"]: len(r["s"]) for r in short} == {100: 0, 1: 0, 300: 199}


def test_match_saved_keeps_ticket_order(spark):
    saved = spark.createDataFrame([("moon_phase_8", "Firenze", [15, 25, 61, 71, 75]), ("moon_phase_8", "Bari", [24, 52, 61, 79, 81])],
                                  "method string, series string, ticket array<int>")
    actual = spark.createDataFrame([("Firenze", [44, 41, 61, 8, 2]), ("Bari", [50, 20, 35, 6, 4])], "series string, numbers array<int>")
    rows = {r["series"]: r for r in bt.match_saved(saved, actual).collect()}
    assert rows["Firenze"]["hits"] == [61] and rows["Bari"]["hits"] == [] and rows["Bari"]["method_total"] == 1
    flags = spark.createDataFrame([([2, 7, 12, 18, 28, 85], [5, 12, 28, 41, 56, 66], 73, 85)],
                                  "ticket array<int>, numbers array<int>, bonus int, superstar int")
    row = bt.bonus_flags(flags).first()
    assert (row["hit_count"], row["bonus_hit"], row["superstar_hit"]) == (2, False, True)


def test_frequency_family_on_a_tiny_series(make_draws):
    game = Game(pool=6, pick=2, decade=3)
    draws = make_draws([[1, 2], [2, 3], [2, 3]])
    counts = {r["number"]: r["occurrences"] for r in fq.number_counts(draws, game).collect()}
    assert counts == {1: 1, 2: 3, 3: 2, 4: 0, 5: 0, 6: 0}
    fit = fq.uniformity(fq.number_counts(draws, game)).first()
    assert (fit["pearson"], fit["max_deviation"], fit["min_count"], fit["max_count"]) == (8.0, 2.0, 0, 3)
    pairs = [(r["a"], r["b"], r["occurrences"]) for r in fq.top_pairs(fq.all_pairs(fq.pair_counts(draws), game), 3).orderBy("position").collect()]
    assert pairs == [(2, 3, 2), (1, 2, 1), (1, 3, 0)]
    assert [r["shared"] for r in fq.serial_overlaps(draws).orderBy("draw_idx").collect()] == [1, 2]


@pytest.mark.parametrize("rule, expected", [("n_minus_one", 10), ("n", 20)])
def test_the_two_quantile_rules_differ(spark, rule, expected):
    values = spark.createDataFrame([(v,) for v in (40, 10, 30, 20)], "v int")
    assert [(r["rule"], r["quantile"]) for r in st.order_statistics(values, "v", [], [0.3], rule).collect()] == [(rule, expected)]


@pytest.mark.parametrize("rule", ["n_minus_one", "n"])
def test_order_statistics_equal_the_sorted_array(spark, rule):
    """A group with a hot value, a smooth one and a tiny one."""
    rng = np.random.default_rng(2)
    groups = {"hot": [1.5] * 3000 + rng.random(500).tolist(), "smooth": rng.normal(size=4000).tolist(), "tiny": [3.0, 1.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    wanted = [0.0, 0.05, 0.3, 0.5, 0.95, 0.9999]
    found = st.order_statistics(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], wanted, rule).collect()
    expected = {(k, p): sorted(vs)[int((len(vs) - 1) * p) if rule == "n_minus_one" else int(len(vs) * p)]
                for k, vs in groups.items() for p in wanted}
    assert {(r["k"], r["probability"]): r["quantile"] for r in found} == expected


def test_ledger_scores_before_rolling_forward(make_draws):
    draws = rf.random_draws(215, seed=9)
    indexed = make_draws(draws).withColumn("bonus", F.lit(None).cast("int"))
    rows = lg.ledger(indexed, SINGLE_GAME, 208, target=5).collect()
    assert len(rows) == 15 and {r["processed_draws"] for r in rows} == {1, 2, 3, 4, 5}
    for r in rows:
        i = 207 + r["processed_draws"]
        assert r["contest"] == i + 1 and r["actual"] == draws[i]
        assert r["status"] == ("COMPLETE" if r["processed_draws"] == 5 else "ACTIVE")
        if r["method"] == "integrated":
            assert r["prediction"] == rf.horizon_ticket(draws[:i])
        assert (r["gross_return"] is None) == (r["main_hits"] >= 2)


# ---------------------------------------------------------------------- Monte Carlo

AUDIT = "series string, draws int, observed double"


def test_published_verification_null(spark):
    """Same generator, sampler and seed as the published run: equal to the last digit of the p values."""
    sizes = spark.createDataFrame([("s", 796, 76.34924623115576)], AUDIT)
    row = ex.null_summary(mc.pearson_null_verification(sizes, SINGLE_GAME, 20000), "pearson").first()
    assert (row["lower_p"], row["upper_p"], row["two_sided_p"]) == (0.2782360881955902, 0.7232138393080346, 0.5564721763911804)
    assert (row["p05"], row["median"], row["p95"]) == pytest.approx((64.62814070351757, 83.47236180904522, 105.44472361809048))


def test_published_pair_null(spark):
    sizes = spark.createDataFrame([("s", 796, 11.0)], AUDIT)
    row = ex.null_summary(mc.pair_max_null(sizes, SINGLE_GAME, 10000), "max_pair").first()
    assert row["p95"] == 13 and row["upper_p"] == 0.6583341665833417


def test_rejection_null_agrees_with_the_published_one(spark):
    sizes = spark.createDataFrame([("s", 796, 76.34924623115576)], AUDIT)
    row = ex.null_summary(mc.pearson_null(sizes, SINGLE_GAME, 20000), "pearson").first()
    assert row["two_sided_p"] == pytest.approx(0.557, abs=0.03)
    assert (row["p05"], row["median"], row["p95"]) == pytest.approx((64.59, 83.43, 105.29), abs=1.0)


def test_rejection_sampler_equals_sequential():
    """Replica 0 consumes its stream number by number, repeats inside a draw are drawn again."""
    draws, game, position, counts = 40, WHEEL_GAME, 0, np.zeros(90, dtype=int)
    for _ in range(draws):
        used = set()
        while len(used) < game.pick:
            used.add(int(uniforms_at(11, np.array([position]))[0] * 90))
            position += 1
        for n in used:
            counts[n] += 1
    batch = mc.rejection_counts(draws, mc.counter_uniform(11, np.array([0, 10**6])), 2, game)
    assert batch[0].tolist() == counts.tolist() and batch[1].sum() == draws * game.pick


def test_floyd_lanes_equal_one_long_stream():
    game, draws = SINGLE_GAME, 5
    lanes = mc.floyd_draws(mc.xorshift_uniform(77, np.arange(3), draws * game.pick), 3, game)
    got = np.stack([next(lanes) for _ in range(draws)])
    state, expected = np.array([77], dtype=np.uint32), []
    for _ in range(3 * draws):
        picked = []
        for top in range(84, 90):
            state = xorshift_step(state)
            candidate = int(state[0] / 4294967296.0 * (top + 1))
            picked.append(top if candidate in picked else candidate)
        expected.append(picked)
    for lane in range(3):
        assert [got[d, :, lane].tolist() for d in range(draws)] == expected[lane * draws:(lane + 1) * draws]


def test_archive_null_mean(spark):
    sizes = spark.createDataFrame([("s", 588, 0.0)], AUDIT)
    null = mc.archive_null(sizes, SINGLE_GAME, 4000, 20261002, 199).agg(F.avg("total_hits"), F.count("*")).first()
    assert null[0] == pytest.approx(235.2, abs=1.0) and null[1] == 4000
