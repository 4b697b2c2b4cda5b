"""The registered queries as SQL for an independent engine, written from the definitions and not from the
DataFrame plans: plain window frames instead of running totals, joins instead of arrays, a discrete Fourier
inversion instead of convolution, log-gamma instead of running ratios."""

from __future__ import annotations

from math import comb

from drawstat.functions.sky import BODIES, ELEMENTS, KEPLER_STEPS, MOON_ARGUMENTS, MOON_TERMS, PRECESSION
from drawstat.settings import (AUDIT_SEED, BINNED_MODELS, FEATURES, FORWARD_SEED, FORWARD_TARGET, HISTORY_WINDOW, HORIZONS,
                               SHIFT_REPLICATES, SHIFT_SEED, SHRINKAGE_DRAWS, WHEEL_SHIFT_REPLICATES, WHEEL_SHIFT_SEED)

ORACLE: dict[str, str] = {}


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


# --------------------------------------------------------------------------- draws


def draws_cte(series: str, day: str, pick: int, complete: bool) -> str:
    kept = "AND draw_date IN (SELECT draw_date FROM full_dates)" if complete else ""
    full = (f""", full_dates AS (SELECT draw_date FROM rk WHERE c >= {pick} GROUP BY draw_date
        HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM rk WHERE c >= {pick}))""" if complete else "")
    return f"""
cand AS (SELECT {series} AS series, CAST({day} AS DATE) AS draw_date, CAST(l_partkey % 90 + 1 AS INTEGER) AS number,
    min(l_orderkey) AS first_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY series, draw_date ORDER BY first_key, number) AS r,
    count(*) OVER (PARTITION BY series, draw_date) AS c FROM cand){full},
dn AS (SELECT series, draw_date, number FROM rk WHERE r <= {pick} AND c >= {pick} {kept}),
bonus AS (SELECT series, draw_date, number AS bonus FROM rk WHERE r = {pick + 1}),
dd AS (SELECT series, draw_date, CAST(row_number() OVER (PARTITION BY series ORDER BY draw_date) - 1 AS INTEGER) AS draw_idx,
    CAST(count(*) OVER (PARTITION BY series) AS INTEGER) AS n_draws FROM (SELECT DISTINCT series, draw_date FROM dn)),
hits AS (SELECT dd.series, draw_idx, n_draws, dd.draw_date, number FROM dn JOIN dd USING (series, draw_date)),
dr AS (SELECT series, draw_idx, n_draws, draw_date, list(number ORDER BY number) AS nums,
    string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM hits GROUP BY 1, 2, 3, 4)"""


DAILY = draws_cte("'all'", "o_orderdate", 6, False)
WEEKLY = draws_cte("coalesce(o_orderpriority, '(none)')", "date_trunc('week', o_orderdate)", 5, True)
POOL = "pool AS (SELECT CAST(unnest(range(1, 91)) AS INTEGER) AS number)"
GRID = f"""{POOL},
steps AS (SELECT series, draw_idx, draw_date, n_draws FROM dd
    UNION ALL SELECT DISTINCT series, n_draws, CAST(NULL AS DATE), n_draws FROM dd),
grid AS (SELECT s.series, s.draw_idx, s.draw_date, s.n_draws, p.number, CASE WHEN h.number IS NULL THEN 0 ELSE 1 END AS hit
    FROM steps s CROSS JOIN pool p LEFT JOIN hits h ON h.series = s.series AND h.draw_idx = s.draw_idx AND h.number = p.number)"""

RAW = """
ord_nums AS (SELECT o_orderpriority AS source, o_orderkey AS source_ord, CAST(o_orderdate AS DATE) AS draw_date,
    CAST(o_custkey % 90 + 1 AS INTEGER) AS bonus,
    (SELECT 1) AS one, list(DISTINCT CAST(l_partkey % 90 + 1 AS INTEGER)) AS ns
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
raw AS (SELECT source, source_ord, draw_date, bonus, list_sort(ns) AS nums, array_to_string(list_sort(ns), ',') AS numbers FROM ord_nums),
chk AS (SELECT *, len(nums) = 6 AS numbers_ok, NOT list_contains(nums, bonus) AS bonus_ok FROM raw)"""

ORACLE["draw_series"] = with_(DAILY) + """SELECT series, draw_idx, n_draws, draw_date, numbers, bonus
FROM dr LEFT JOIN bonus USING (series, draw_date)"""
ORACLE["draw_series_weekly"] = with_(WEEKLY) + "SELECT series, draw_idx, n_draws, draw_date, numbers FROM dr"
ORACLE["announcement_checks"] = with_(RAW) + """SELECT source, source_ord, numbers,
concat_ws(',', CASE WHEN NOT numbers_ok THEN 'numbers' END, CASE WHEN NOT bonus_ok THEN 'bonus' END) AS violations FROM chk"""
ORACLE["announcement_violations"] = with_(RAW) + """SELECT violation, count(*) AS n_rows FROM (
SELECT 'any' AS violation FROM chk WHERE NOT (numbers_ok AND bonus_ok) UNION ALL SELECT 'numbers' FROM chk WHERE NOT numbers_ok
UNION ALL SELECT 'bonus' FROM chk WHERE NOT bonus_ok) GROUP BY 1"""
ORACLE["date_texts"] = """WITH t AS (SELECT strftime(l_shipdate, '%Y-%m') || '-' || lpad(CAST(l_orderkey % 34 AS VARCHAR), 2, '0') AS date_text FROM lineitem)
SELECT date_text, count(*) AS n_rows, try_cast(date_text AS DATE) IS NOT NULL AS valid FROM t GROUP BY 1"""
ORACLE["draws_between"] = with_(DAILY) + """SELECT series, draw_date, numbers, bonus FROM dr LEFT JOIN bonus USING (series, draw_date)
WHERE draw_date BETWEEN DATE '1995-06-01' AND DATE '1996-12-31'"""


def dedup(keys: str, direction: str, content: str) -> str:
    return with_(RAW) + f"""SELECT draw_date, source, source_ord, numbers, bonus, n_rows, conflict FROM (
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY source_ord {direction}) AS r FROM raw)
JOIN (SELECT {keys}, count(*) AS n_rows, count(DISTINCT {content}) > 1 AS conflict FROM raw GROUP BY {keys}) USING ({keys}) WHERE r = 1"""


ORACLE["dedup_first"] = dedup("draw_date", "ASC", "numbers || '/' || bonus")
ORACLE["dedup_last"] = dedup("draw_date", "DESC", "numbers || '/' || bonus")
ORACLE["dedup_last_numbers_only"] = dedup("source, draw_date", "DESC", "numbers")
ORACLE["coverage"] = with_(RAW) + """SELECT min(draw_date) AS first_date, max(draw_date) AS last_date, count(*) AS draws,
CAST(sum(n) AS BIGINT) AS raw_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, count(*) FILTER (contents > 1) AS conflicting_dates
FROM (SELECT draw_date, count(*) AS n, count(DISTINCT numbers || '/' || bonus) AS contents FROM raw GROUP BY 1)"""
ORACLE["announcement_intake"] = with_(RAW, """
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw_date ORDER BY source_ord) AS r FROM chk
    WHERE numbers_ok AND bonus_ok) WHERE r = 1)""") + """
SELECT c.draw_date, any_value(rec.numbers) AS numbers, any_value(rec.bonus) AS bonus, any_value(rec.source_ord) AS first_ord,
count(*) AS announced, count(*) FILTER (NOT (numbers_ok2 AND bonus_ok2)) AS refused,
count(*) FILTER (numbers_ok2 AND bonus_ok2 AND c.numbers = rec.numbers AND c.bonus = rec.bonus AND c.source_ord <> rec.source_ord) AS repeated,
count(*) FILTER (numbers_ok2 AND bonus_ok2 AND (c.numbers <> rec.numbers OR c.bonus <> rec.bonus)) AS conflicting
FROM (SELECT *, numbers_ok AS numbers_ok2, bonus_ok AS bonus_ok2 FROM chk) c LEFT JOIN rec ON rec.draw_date = c.draw_date GROUP BY c.draw_date"""

# --------------------------------------------------------------------- frequencies

FREQ = f"""{POOL},
freq AS (SELECT s.series, p.number, count(h.number) AS occurrences, s.drawn / 90.0::DOUBLE AS expected
    FROM (SELECT series, count(*) AS drawn FROM hits GROUP BY 1) s CROSS JOIN pool p
    LEFT JOIN hits h ON h.series = s.series AND h.number = p.number GROUP BY s.series, p.number, s.drawn)"""
FREQ_COLUMNS = "series, number, occurrences, round(expected, 9) AS expected, round(occurrences - expected, 9) AS deviation"
UNIFORMITY = """SELECT series, round(sum((occurrences - expected) * (occurrences - expected) / expected), 9) AS pearson,
round(max(abs(occurrences - expected)), 9) AS max_deviation, min(occurrences) AS min_count, max(occurrences) AS max_count
FROM freq GROUP BY 1"""
ORACLE["number_frequencies"] = with_(DAILY, FREQ) + f"SELECT {FREQ_COLUMNS} FROM freq"
ORACLE["uniformity"] = with_(DAILY, FREQ) + UNIFORMITY
ORACLE["uniformity_weekly"] = with_(WEEKLY, FREQ) + UNIFORMITY
for _name, _order in (("top_numbers", "DESC"), ("bottom_numbers", "ASC")):
    ORACLE[_name] = with_(DAILY, FREQ) + f"""SELECT {FREQ_COLUMNS}, CAST(position AS INTEGER) AS position FROM (SELECT *,
row_number() OVER (PARTITION BY series ORDER BY occurrences {_order}, number) AS position FROM freq) WHERE position <= 10"""
PAIRS = f"""{POOL},
found AS (SELECT x.series, x.number AS a, y.number AS b, count(*) AS n FROM hits x JOIN hits y
    ON x.series = y.series AND x.draw_idx = y.draw_idx AND x.number < y.number GROUP BY 1, 2, 3),
pairs AS (SELECT s.series, p.number AS a, q.number AS b, coalesce(f.n, 0) AS occurrences FROM (SELECT DISTINCT series FROM dd) s
    CROSS JOIN pool p JOIN pool q ON p.number < q.number
    LEFT JOIN found f ON f.series = s.series AND f.a = p.number AND f.b = q.number)"""
ORACLE["pair_counts"] = with_(DAILY, PAIRS) + "SELECT * FROM pairs"
ORACLE["top_pairs"] = with_(DAILY, PAIRS) + """SELECT series, a, b, occurrences, CAST(position AS INTEGER) AS position FROM (SELECT *,
row_number() OVER (PARTITION BY series ORDER BY occurrences DESC, a, b) AS position FROM pairs) WHERE position <= 10"""
ORACLE["pair_summary"] = with_(DAILY, PAIRS) + """SELECT p.series, count(*) AS candidate_pairs, CAST(sum(occurrences) AS BIGINT) AS pair_occurrences,
round(CAST(sum(occurrences) AS DOUBLE) / count(*), 9) AS expected_per_pair, max(occurrences) AS max_pair_count FROM pairs p GROUP BY 1"""
SERIAL = """
shared AS (SELECT x.series, x.draw_idx, x.draw_date, count(y.number) AS shared FROM hits x
    LEFT JOIN hits y ON y.series = x.series AND y.draw_idx = x.draw_idx - 1 AND y.number = x.number WHERE x.draw_idx > 0 GROUP BY 1, 2, 3)"""
ORACLE["serial_overlaps"] = with_(DAILY, SERIAL) + "SELECT series, draw_idx, draw_date, CAST(shared AS INTEGER) AS shared FROM shared"
SERIAL_TEST = SERIAL + "," + """
tot AS (SELECT series, count(*) AS m, CAST(sum(shared) AS BIGINT) AS s, count(*) FILTER (shared >= 2) AS k FROM shared GROUP BY 1),
nullp AS (SELECT 1 - (exp(lgamma(85) - lgamma(79)) + 6 * 6 * exp(lgamma(85) - lgamma(80))) / exp(lgamma(91) - lgamma(85)) AS p),
masses AS (SELECT series, k AS seen, j, lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(p) + (m - j) * ln(1 - p) AS lm
    FROM (SELECT *, unnest(range(0, m + 1)) AS j FROM tot, nullp)),
pv AS (SELECT x.series, least(1.0, sum(exp(x.lm))) AS p_value FROM masses x JOIN masses o ON o.series = x.series AND o.j = o.seen
    WHERE x.lm <= o.lm + 1e-9 GROUP BY 1)"""
ORACLE["serial_test"] = with_(DAILY, SERIAL_TEST) + """
SELECT series, m AS adjacent_pairs, s AS overlap_total, round(s / m::DOUBLE, 9) AS mean_overlap, k AS pairs_at_least_two,
round(p, 9) AS null_probability, round(m * p, 9) AS expected_pairs, round(p_value, 9) AS raw_p FROM tot JOIN pv USING (series), nullp"""

# -------------------------------------------------------------------- walk-forward


def count_over(window: int, value: str = "hit") -> str:
    return (f"coalesce(sum({value}) OVER (PARTITION BY series, number ORDER BY draw_idx "
            f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), 0)")


def z_over(window: int) -> str:
    p = "(6::DOUBLE / 90)"
    return f"({count_over(window)} - {window} * {p}) / sqrt({window} * {p} * (1 - {p})) / 4"


SCORES = f"""{GRID},
scores AS (SELECT series, draw_idx, draw_date, n_draws, number, hit, {' + '.join(z_over(w) for w in HORIZONS)} AS integrated,
    CAST({count_over(52)} AS DOUBLE) AS frequency52 FROM grid)"""


def tickets(source: str, methods: tuple[str, ...], pick: int, where: str, name: str = "tk") -> str:
    """Long tickets (series, draw_idx, draw_date, method, ticket, hits) from wide score columns."""
    union = " UNION ALL ".join(
        f"SELECT series, draw_idx, draw_date, number, hit, '{m}' AS method, {m} AS score FROM {source} WHERE {where}" for m in methods)
    return f"""
{name}_long AS ({union}),
{name}_capped AS (SELECT *, row_number() OVER (PARTITION BY series, draw_idx, method, (number - 1) // 10 ORDER BY score DESC, number) AS in_decade
    FROM {name}_long),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY series, draw_idx, method ORDER BY score DESC, number) AS place
    FROM {name}_capped WHERE in_decade <= 3),
{name} AS (SELECT series, draw_idx, draw_date, method, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS ticket,
    list(number ORDER BY number) AS ticket_nums, CAST(sum(hit) AS INTEGER) AS hits FROM {name}_ranked WHERE place <= {pick} GROUP BY 1, 2, 3, 4)"""


def uniforms(seed: int, source: str, name: str = "un") -> str:
    """Uniform of the counter generator at ``pos`` for every row of ``source`` (rows keep their columns)."""
    mask, step = 4294967295, 0x6D2B79F5
    return f"""
{name}_a AS (SELECT *, ({seed} + (((CAST(pos AS UBIGINT) + 1) & {mask}) * {step}::UBIGINT & {mask})) & {mask} AS a FROM {source}),
{name}_b AS (SELECT *, (xor(a, a >> 15) * (a | 1::UBIGINT)) & {mask} AS b FROM {name}_a),
{name}_c AS (SELECT *, xor(b, (b + ((xor(b, b >> 7) * (b | 61::UBIGINT)) & {mask})) & {mask}) AS c FROM {name}_b),
{name} AS (SELECT * EXCLUDE (a, b, c), CAST(xor(c, c >> 14) AS DOUBLE) / 4294967296 AS u FROM {name}_c)"""


def random_tickets(seed: int, keys: str, source: str, position: str, name: str = "rt") -> str:
    """Floyd tickets per row of ``source``; six uniforms from stream position 6 * ``position``."""
    slots = [84 + j for j in range(6)]
    pivot = ", ".join(f"max(CASE WHEN j = {j} THEN CAST(floor(u * {slot + 1}) AS INTEGER) END) AS c{j}" for j, slot in enumerate(slots))
    chain, previous = [], f"{name}_p"
    for j, slot in enumerate(slots):
        taken = " OR ".join(f"c{j} = s{i}" for i in range(j)) or "FALSE"
        chain.append(f"{name}_{j} AS (SELECT *, CASE WHEN {taken} THEN {slot} ELSE c{j} END AS s{j} FROM {previous})")
        previous = f"{name}_{j}"
    listed = "list_sort([" + ", ".join(f"s{j} + 1" for j in range(6)) + "])"
    return f"""
{name}_src AS (SELECT {keys}, j, CAST(({position}) * 6 + j AS BIGINT) AS pos FROM {source}, (SELECT unnest(range(0, 6)) AS j)),
{uniforms(seed, f'{name}_src', f'{name}_u')},
{name}_p AS (SELECT {keys}, {pivot} FROM {name}_u GROUP BY {keys}),
{', '.join(chain)},
{name} AS (SELECT {keys}, {listed} AS ticket_nums, array_to_string({listed}, ',') AS ticket FROM {previous})"""


WALK = with_(DAILY, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx >= {HISTORY_WINDOW} AND draw_idx < n_draws"),
             random_tickets(AUDIT_SEED, "series, draw_idx", f"(SELECT * FROM dd WHERE draw_idx >= {HISTORY_WINDOW})", f"draw_idx - {HISTORY_WINDOW}"),
             """
walk AS (SELECT d.series, d.draw_idx, d.draw_date, d.numbers AS actual, i.ticket AS integrated_ticket, f.ticket AS frequency52_ticket,
    rt.ticket AS random_ticket, i.hits AS integrated_hits, f.hits AS frequency52_hits,
    CAST(len(list_intersect(rt.ticket_nums, d.nums)) AS INTEGER) AS random_hits
    FROM dr d JOIN tk i ON i.series = d.series AND i.draw_idx = d.draw_idx AND i.method = 'integrated'
    JOIN tk f ON f.series = d.series AND f.draw_idx = d.draw_idx AND f.method = 'frequency52'
    JOIN rt ON rt.series = d.series AND rt.draw_idx = d.draw_idx)""")
ORACLE["horizon_scores"] = with_(DAILY, SCORES) + """SELECT series, draw_idx, number, hit, round(integrated, 9) AS integrated,
round(frequency52, 9) AS frequency52 FROM scores WHERE draw_idx < n_draws"""
ORACLE["walk_forward"] = WALK + "SELECT * FROM walk"
ORACLE["next_tickets"] = with_(DAILY, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx = n_draws AND n_draws >= {HISTORY_WINDOW}")) + """
SELECT series, draw_idx, max(ticket) FILTER (method = 'integrated') AS integrated_ticket,
max(ticket) FILTER (method = 'frequency52') AS frequency52_ticket FROM tk GROUP BY 1, 2"""


def tested(totals: str, pick: int, family: str) -> str:
    """Exact tails by Fourier inversion and Holm, from totals(<keys>, method, trials, total_hits)."""
    # counts of tickets by overlap are whole numbers; rounded log-gamma masses would be off by 1e-11 after the power
    masses = " UNION ALL ".join(
        f"SELECT {k} AS k, {comb(pick, k) * comb(90 - pick, pick - k)} / {comb(90, pick)}::DOUBLE AS h" for k in range(pick + 1))
    partition = f"PARTITION BY {family}" if family else ""
    return f"""
pmf AS ({masses}),
freqs AS (SELECT trials, unnest(range(0, {pick} * trials + 1)) AS t, {pick} * trials + 1 AS m FROM (SELECT DISTINCT trials FROM {totals})),
phi AS (SELECT trials, m, t, 2 * pi() * t / m AS th, sum(h * cos(2 * pi() * t * k / m)) AS re, sum(h * sin(2 * pi() * t * k / m)) AS im
    FROM freqs, pmf GROUP BY trials, m, t),
powered AS (SELECT trials, m, t, th, exp(trials * ln(greatest(sqrt(re * re + im * im), 1e-300))) AS rad, trials * atan2(im, re) AS ang FROM phi),
seen AS (SELECT DISTINCT trials, total_hits FROM {totals}),
sums AS (SELECT trials, total_hits,
    sum(CASE WHEN t = 0 THEN (m - total_hits) / m::DOUBLE ELSE
        rad * ((cos(ang - th * total_hits) - cos(ang - th * m)) * (1 - cos(th)) + (sin(ang - th * total_hits) - sin(ang - th * m)) * sin(th))
        / ((1 - cos(th)) * (1 - cos(th)) + sin(th) * sin(th)) / m END) AS up,
    sum(rad * cos(ang - th * total_hits) / m) AS mass FROM seen JOIN powered USING (trials) GROUP BY 1, 2),
pt AS (SELECT w.*, least(1.0, greatest(0.0, up)) AS upper_p, least(1.0, greatest(0.0, 1 - up + mass)) AS lower_p
    FROM {totals} w JOIN sums USING (trials, total_hits)),
rkp AS (SELECT *, row_number() OVER ({partition} ORDER BY upper_p) - 1 AS step, count(*) OVER ({partition}) AS fam FROM pt),
tested AS (SELECT * EXCLUDE (step, fam), max(least(1.0, (fam - step) * upper_p)) OVER ({partition} ORDER BY upper_p ROWS UNBOUNDED PRECEDING) AS holm_p,
    least(1.0, 2 * least(lower_p, upper_p)) AS two_sided_p FROM rkp)"""


TEST_COLUMNS = """method, trials, total_hits, round(total_hits / trials::DOUBLE, 9) AS mean_hits, round(trials * {e}, 9) AS expected_hits,
abs(round(lower_p, 9)) AS lower_p, abs(round(upper_p, 9)) AS upper_p, abs(round(two_sided_p, 9)) AS two_sided_p, abs(round(holm_p, 9)) AS holm_p"""
E6, E5 = "(36::DOUBLE / 90)", "(25::DOUBLE / 90)"
WALK_TOTALS = """
totals AS (SELECT series, m.method, count(*) AS trials, CAST(sum(m.hits) AS BIGINT) AS total_hits FROM (
    SELECT series, unnest([{'method': 'integrated', 'hits': integrated_hits}, {'method': 'frequency52', 'hits': frequency52_hits},
    {'method': 'random', 'hits': random_hits}]) AS m FROM walk) GROUP BY 1, 2)"""
ORACLE["method_tests"] = WALK + "," + WALK_TOTALS + "," + tested("totals", 6, "series") + f"\nSELECT series, {TEST_COLUMNS.format(e=E6)} FROM tested"
ORACLE["exact_null"] = with_(DAILY, f"""
totals AS (SELECT series, 'x' AS method, count(*) AS trials, 0 AS total_hits FROM dd WHERE draw_idx >= {HISTORY_WINDOW} GROUP BY 1)""",
                             tested("totals", 6, "series")) + """
SELECT series, k.total_hits, abs(round(sum(rad * cos(ang - th * k.total_hits) / m), 9)) AS probability
FROM powered JOIN (SELECT series, trials, unnest(range(0, 6 * trials + 1)) AS total_hits FROM totals) k USING (trials)
WHERE rad > 1e-18 GROUP BY 1, 2"""

# ---------------------------------------------------------------- date-conditioned


def sky_cte(days: str) -> str:
    rows = ", ".join(f"('{body}', {', '.join(f'CAST({v!r} AS DOUBLE)' for v in values)})" for body, values in ELEMENTS.items())
    names = ", ".join(f"v{i}" for i in range(12))

    def element(i: int) -> str:
        return f"(v{2 * i} + v{2 * i + 1} * t)"

    def wrap(x: str) -> str:
        return f"(({x}) - 360 * floor(({x}) / 360))"

    newton, source = [], "orb0"
    for step in range(KEPLER_STEPS):
        newton.append(f"orb{step + 1} AS (SELECT * REPLACE (ecc - (ecc - e * sin(ecc) - anomaly) / (1 - e * cos(ecc)) AS ecc) FROM {source})")
        source = f"orb{step + 1}"
    wide = ", ".join(f"max(CASE WHEN body = '{b}' THEN {axis} END) AS {axis}_{b}" for b in ELEMENTS for axis in ("x", "y"))
    lon = ", ".join(
        wrap(f"degrees(atan2({'' if b == 'Sun' else f'y_{b} '}- y_Earth, {'' if b == 'Sun' else f'x_{b} '}- x_Earth)) + {PRECESSION} * t") + f" AS {b}"
        for b in BODIES)
    args = [f"({start} + {rate} * t)" for start, rate in MOON_ARGUMENTS]
    moon = args[0] + "".join(
        f" + ({amp}) * sin(radians({' + '.join(f'({m}) * {a}' for m, a in zip(ms, args[1:]) if m)}))" for amp, *ms in MOON_TERMS)
    bins = ", ".join(f"CAST(floor({b} / 30) AS INTEGER) AS {b}" for b in BODIES)
    separation = "least(fmod(abs(Mercury - Venus), 360), 360 - fmod(abs(Mercury - Venus), 360))"
    aspect = "CASE " + " ".join(f"WHEN abs({separation} - {a}) <= 6 THEN {i}" for i, a in enumerate((0, 90, 120, 180))) + " ELSE 4 END"
    return f"""
days AS ({days}),
dst AS (SELECT draw_date, CASE WHEN draw_date >= last_day(make_date(year(draw_date), 3, 1)) - CAST(dayofweek(last_day(make_date(year(draw_date), 3, 1))) AS INTEGER)
    AND draw_date < last_day(make_date(year(draw_date), CASE WHEN year(draw_date) < 1996 THEN 9 ELSE 10 END, 1))
        - CAST(dayofweek(last_day(make_date(year(draw_date), CASE WHEN year(draw_date) < 1996 THEN 9 ELSE 10 END, 1))) AS INTEGER)
    THEN 18 ELSE 19 END AS h FROM days),
timed AS (SELECT draw_date, CAST(draw_date AS TIMESTAMP) + to_hours(h) AS utc,
    (date_diff('day', DATE '2000-01-01', draw_date) + h / 24::DOUBLE - 0.5::DOUBLE) / 36525::DOUBLE AS t FROM dst),
els AS (SELECT * FROM (VALUES {rows}) AS e(body, {names})),
orb AS (SELECT draw_date, utc, t, body, {element(0)} AS a, {element(1)} AS e, radians({element(2)}) AS incl,
    radians({wrap(f'{element(3)} - {element(4)}')}) AS anomaly, radians({element(4)} - {element(5)}) AS peri, radians({element(5)}) AS node
    FROM timed, els),
orb0 AS (SELECT *, anomaly + e * sin(anomaly) AS ecc FROM orb),
{', '.join(newton)},
plane AS (SELECT *, a * (cos(ecc) - e) AS p, a * sqrt(1 - e * e) * sin(ecc) AS q FROM {source}),
space AS (SELECT draw_date, utc, t, body,
    (cos(peri) * cos(node) - sin(peri) * sin(node) * cos(incl)) * p + (-sin(peri) * cos(node) - cos(peri) * sin(node) * cos(incl)) * q AS x,
    (cos(peri) * sin(node) + sin(peri) * cos(node) * cos(incl)) * p + (-sin(peri) * sin(node) + cos(peri) * cos(node) * cos(incl)) * q AS y FROM plane),
wide AS (SELECT draw_date, utc, t, {wide} FROM space GROUP BY 1, 2, 3),
located AS (SELECT draw_date, utc, t, {lon} FROM wide),
sky AS (SELECT * EXCLUDE (t), {wrap(f'{moon} - Sun')} AS MoonPhase FROM located),
bins AS (SELECT draw_date, CAST(floor(MoonPhase / 45) AS INTEGER) AS MoonPhase, {bins}, {aspect} AS MercuryVenusAspect FROM sky)"""


ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS draw_date FROM orders"
DRAW_DAYS = "SELECT DISTINCT draw_date FROM dd"
ORACLE["draw_instants"] = with_(sky_cte(ORDER_DAYS)) + "SELECT draw_date, utc FROM timed"
ORACLE["sky_angles"] = with_(sky_cte(ORDER_DAYS)) + "SELECT draw_date, utc, " + ", ".join(
    f"round({b}, 6) AS {b}" for b in (*BODIES, "MoonPhase")) + " FROM sky"
ORACLE["sky_bins"] = with_(DAILY, sky_cte(DRAW_DAYS)) + "SELECT * FROM bins"


def binned(shift: int, pick: int) -> str:
    """Tickets ``tk`` of every model and the baseline, plain range frames per feature."""
    w, prior = HISTORY_WINDOW, SHRINKAGE_DRAWS
    feats = ", ".join(f"b.{f}" for f in FEATURES)
    counts = ", ".join(
        f"coalesce(sum(hit) OVER (PARTITION BY series, number, {f} ORDER BY draw_idx RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS h_{f}, "
        f"count(*) OVER (PARTITION BY series, number, {f} ORDER BY draw_idx RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS s_{f}" for f in FEATURES)
    models = ", ".join(
        "(" + " + ".join(f"(h_{f} + {prior} * g / {w}::DOUBLE) / (s_{f} + {prior})::DOUBLE" for f in fs) + f") / {len(fs)} AS {m}"
        for m, fs in BINNED_MODELS.items())
    return f"""{GRID},
moved AS (SELECT d.series, d.draw_idx, {feats} FROM dd d JOIN dd f ON f.series = d.series AND f.draw_idx = (d.draw_idx + {shift}) % d.n_draws
    JOIN bins b ON b.draw_date = f.draw_date),
counted AS (SELECT g.series, g.draw_idx, g.draw_date, g.number, g.hit, {count_over(w).replace('series', 'g.series').replace('draw_idx', 'g.draw_idx')} AS g,
    {counts.replace('series,', 'g.series,').replace('draw_idx', 'g.draw_idx')} FROM grid g JOIN moved ON moved.series = g.series AND moved.draw_idx = g.draw_idx),
scored AS (SELECT series, draw_idx, draw_date, number, hit, CAST(g AS DOUBLE) AS frequency, {models} FROM counted),
{tickets('scored', (*BINNED_MODELS, 'frequency'), pick, f'draw_idx >= {w}')}"""


LONG = """SELECT tk.series, tk.draw_idx, tk.draw_date, dr.numbers AS actual, method, ticket, hits FROM tk
JOIN dr ON dr.series = tk.series AND dr.draw_idx = tk.draw_idx"""
TOTALS = "totals AS (SELECT series, method, count(*) AS trials, CAST(sum(hits) AS BIGINT) AS total_hits FROM tk GROUP BY 1, 2)"
POOLED = "totals AS (SELECT method, count(*) AS trials, CAST(sum(hits) AS BIGINT) AS total_hits FROM tk WHERE method <> 'frequency' GROUP BY 1)"
DAILY_BINNED = with_(DAILY, sky_cte(DRAW_DAYS), binned(0, 6))
WEEKLY_BINNED = with_(WEEKLY, sky_cte(DRAW_DAYS), binned(0, 5))
ORACLE["binned_backtest"] = DAILY_BINNED + LONG
ORACLE["binned_totals"] = DAILY_BINNED + "," + TOTALS + ", models AS (SELECT * FROM totals WHERE method <> 'frequency')," + tested("models", 6, "series") + f"""
SELECT series, {TEST_COLUMNS.format(e=E6)}, b.baseline, total_hits - b.baseline AS difference FROM tested
JOIN (SELECT series, total_hits AS baseline FROM totals WHERE method = 'frequency') b USING (series)"""
ORACLE["rotated_totals"] = with_(DAILY, sky_cte(DRAW_DAYS), binned(37, 6), TOTALS) + f"""SELECT series, method, trials, total_hits,
round(total_hits / trials::DOUBLE, 9) AS mean_hits, round(trials * {E6}, 9) AS expected_hits FROM totals"""
ORACLE["weekly_backtest"] = WEEKLY_BINNED + LONG
ORACLE["weekly_rollup"] = WEEKLY_BINNED + """SELECT method, series, count(*) AS trials, CAST(sum(hits) AS BIGINT) AS total_hits
FROM tk GROUP BY ROLLUP (method, series)"""
ORACLE["weekly_tests"] = WEEKLY_BINNED + "," + POOLED + "," + tested("totals", 5, "") + f"\nSELECT {TEST_COLUMNS.format(e=E5)} FROM tested"
LAST = "last AS (SELECT * FROM tk JOIN (SELECT series, max(draw_idx) AS draw_idx FROM tk GROUP BY 1) USING (series, draw_idx) WHERE method <> 'frequency')"
ORACLE["weekly_last_predictions"] = WEEKLY_BINNED + "," + LAST + "\nSELECT series, draw_date, method, ticket FROM last"
ORACLE["weekly_saved_matches"] = WEEKLY_BINNED + "," + LAST + """
SELECT series, method, ticket, numbers, hits, hit_count, CAST(sum(hit_count) OVER (PARTITION BY method) AS BIGINT) AS method_total FROM (
SELECT last.series, method, ticket, dr.numbers, array_to_string(list_filter(ticket_nums, lambda x: list_contains(dr.nums, x)), ',') AS hits,
CAST(last.hits AS INTEGER) AS hit_count FROM last JOIN dr ON dr.series = last.series AND dr.draw_idx = dr.n_draws - 1)"""


def shifts(source: str, seed: int, count: int, distinct: bool) -> str:
    over = 20 * count if distinct else count
    first = "WHERE again = 1" if distinct else ""
    return with_(source, f"""
slots AS (SELECT series, n_draws, i, CAST(i AS BIGINT) AS pos FROM (SELECT DISTINCT series, n_draws FROM dd), (SELECT unnest(range(0, {over})) AS i))""",
                 uniforms(seed, "slots")) + f"""
SELECT series, CAST(place - 1 AS INTEGER) AS position, shift FROM (
SELECT series, shift, row_number() OVER (PARTITION BY series ORDER BY i) AS place FROM (
SELECT *, row_number() OVER (PARTITION BY series, shift ORDER BY i) AS again FROM (
SELECT series, i, CAST(1 + floor(u * (n_draws - 1)) AS INTEGER) AS shift FROM un)) {first}) WHERE place <= {count}"""


ORACLE["shift_values"] = shifts(DAILY, SHIFT_SEED, SHIFT_REPLICATES, True)
ORACLE["shift_values_weekly"] = shifts(WEEKLY, WHEEL_SHIFT_SEED, WHEEL_SHIFT_REPLICATES, False)

def shift_tests(source: str, pick: int, seed: int, count: int, distinct: bool, pooled: bool) -> str:
    """Exact and circular-shift tests of every model: two 128-bit halves of the window for every number and every
    cell, their common bits for every replicate, plain window ranks for the tickets."""
    w, prior, half = HISTORY_WINDOW, SHRINKAGE_DRAWS, HISTORY_WINDOW // 2
    listed = shifts(source, seed, count, distinct)

    def halves(off: str) -> str:
        return (f"sum(CASE WHEN {off} < {half} THEN 1::HUGEINT << ({off})::INTEGER ELSE 0 END)::HUGEINT AS m1, "
                f"sum(CASE WHEN {off} >= {half} THEN 1::HUGEINT << ({off} - {half})::INTEGER ELSE 0 END)::HUGEINT AS m2")

    wide = ", ".join(f"max(CASE WHEN f = '{f}' THEN m1 END) AS m1_{f}, max(CASE WHEN f = '{f}' THEN m2 END) AS m2_{f}, max(CASE WHEN f = '{f}' THEN s END) AS s_{f}"
                     for f in FEATURES)
    models = ", ".join(
        "(" + " + ".join(f"(bit_count(n.m1 & b.m1_{f}) + bit_count(n.m2 & b.m2_{f}) + {prior} * n.g / {w}::DOUBLE) / (b.s_{f} + {prior})::DOUBLE" for f in fs)
        + f") / {len(fs)} AS {m}" for m, fs in BINNED_MODELS.items())
    long = " UNION ALL ".join(f"SELECT series, replicate, draw_idx, number, hit, '{m}' AS method, {m} AS score FROM scored" for m in BINNED_MODELS)
    keys, family = ("", "") if pooled else ("series, ", "series")
    return with_(source, sky_cte(DRAW_DAYS), POOL, f"""
reps AS (SELECT series, CAST(0 AS INTEGER) AS replicate, CAST(0 AS INTEGER) AS shift FROM (SELECT DISTINCT series FROM dd)
    UNION ALL SELECT series, position + 1, shift FROM ({listed})),
nm AS (SELECT d.series, d.draw_idx, h.number, {halves(f"(h.draw_idx - d.draw_idx + {w})")}, count(*) AS g FROM dd d
    JOIN hits h ON h.series = d.series AND h.draw_idx BETWEEN d.draw_idx - {w} AND d.draw_idx - 1 WHERE d.draw_idx >= {w} GROUP BY 1, 2, 3),
fb AS (UNPIVOT (SELECT series, draw_idx, n_draws, {", ".join(FEATURES)} FROM dd JOIN bins USING (draw_date)) ON {", ".join(FEATURES)} INTO NAME f VALUE bin),
turned AS (SELECT q.series, q.draw_idx AS position, q.f, {halves(f"({w - 1} - back)")}, count(*) AS s FROM (
    SELECT q.series, q.draw_idx, q.f, (q.draw_idx - p.draw_idx - 1 + q.n_draws) % q.n_draws AS back FROM fb q
    JOIN fb p ON p.series = q.series AND p.f = q.f AND p.bin = q.bin) q WHERE back < {w} GROUP BY 1, 2, 3),
met AS (SELECT series, position, {wide} FROM (SELECT dd.series, dd.draw_idx AS position, e.f, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(s, 0) AS s
    FROM dd CROSS JOIN (SELECT DISTINCT f FROM fb) e LEFT JOIN turned ON turned.series = dd.series AND turned.position = dd.draw_idx AND turned.f = e.f) GROUP BY 1, 2),
dense AS (SELECT d.series, d.draw_idx, d.n_draws, p.number, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(g, 0) AS g,
    CASE WHEN h.number IS NULL THEN 0 ELSE 1 END AS hit FROM dd d CROSS JOIN pool p
    LEFT JOIN nm ON nm.series = d.series AND nm.draw_idx = d.draw_idx AND nm.number = p.number
    LEFT JOIN hits h ON h.series = d.series AND h.draw_idx = d.draw_idx AND h.number = p.number WHERE d.draw_idx >= {w}),
scored AS (SELECT n.series, r.replicate, n.draw_idx, n.number, n.hit, {models} FROM dense n JOIN reps r ON r.series = n.series
    JOIN met b ON b.series = n.series AND b.position = (n.draw_idx + r.shift) % n.n_draws),
long AS ({long}),
capped AS (SELECT *, row_number() OVER (PARTITION BY series, replicate, draw_idx, method, (number - 1) // 10 ORDER BY score DESC, number) AS in_decade FROM long),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series, replicate, draw_idx, method ORDER BY score DESC, number) AS place FROM capped WHERE in_decade <= 3),
tallies AS (SELECT {keys}replicate, method, CAST(sum(hit) AS BIGINT) AS total_hits, count(*) // {pick} AS trials FROM ranked WHERE place <= {pick} GROUP BY ALL),
totals AS (SELECT {keys}method, trials, total_hits FROM tallies WHERE replicate = 0),
turns AS (SELECT {keys}method, (1 + count(*) FILTER (tallies.total_hits >= totals.total_hits)) / (count(*) + 1)::DOUBLE AS shift_p
    FROM tallies JOIN totals USING ({keys}method) WHERE replicate > 0 GROUP BY ALL)""", tested("totals", pick, family), f"""
two AS (SELECT {keys}method AS model, trials, total_hits, 'exact_uniform_upper' AS test, upper_p AS raw_p FROM tested
    UNION ALL SELECT {keys}method, trials, total_hits, 'circular_shift_upper', shift_p FROM totals JOIN turns USING ({keys}method)),
joint AS (SELECT * EXCLUDE (step, m), max(least(1.0, (m - step) * raw_p)) OVER ({f"PARTITION BY {family}" if family else ""} ORDER BY raw_p ROWS UNBOUNDED PRECEDING) AS holm_p FROM (
    SELECT *, row_number() OVER ({f"PARTITION BY {family}" if family else ""} ORDER BY raw_p) - 1 AS step, count(*) OVER ({f"PARTITION BY {family}" if family else ""}) AS m FROM two))""")


JOINT = "model, trials, total_hits, test, abs(round(raw_p, 9)) AS raw_p, abs(round(holm_p, 9)) AS holm_p FROM joint"
# 42 million scores of 2,155 draws and 200 replicates take an engine of one node over 20 GB at sf0.01, so this one is for the
# tests on small tables only; the weekly ones, by the same rules, are for every size
SMALL_ORACLE = {"shift_tests": shift_tests(DAILY, 6, SHIFT_SEED, SHIFT_REPLICATES, True, False) + "SELECT series, " + JOINT}
WEEKLY_SHIFTED = shift_tests(WEEKLY, 5, WHEEL_SHIFT_SEED, WHEEL_SHIFT_REPLICATES, False, True)
ORACLE["shift_tests_weekly"] = WEEKLY_SHIFTED + "SELECT " + JOINT
ORACLE["leaderboard"] = WEEKLY_SHIFTED + f"""
SELECT model AS method, total_hits, round(trials * {E5}, 9) AS expected_hits, round(total_hits - trials * {E5}, 9) AS surplus, abs(round(holm_p, 9)) AS holm_p,
round(least(100.0, total_hits / (trials * {E5} * 1.08::DOUBLE) * 100), 9) AS bar_width,
CAST(row_number() OVER (ORDER BY total_hits DESC, list_position({list(BINNED_MODELS)}, model)) AS INTEGER) AS position FROM joint WHERE test = 'exact_uniform_upper'"""


# ------------------------------------------------------------------------- reports


def recent_top(window: int, limit: int) -> str:
    return with_(WEEKLY) + f"""SELECT series, number, occurrences, CAST(position AS INTEGER) AS position,
CAST(round(100 * occurrences / top::DOUBLE) AS INTEGER) AS bar_width FROM (SELECT *, max(occurrences) OVER (PARTITION BY series) AS top,
row_number() OVER (PARTITION BY series ORDER BY occurrences DESC, number) AS position FROM (
SELECT series, number, count(*) AS occurrences FROM hits WHERE draw_idx >= n_draws - {window} GROUP BY 1, 2)) WHERE position <= {limit}"""


CHECKS = f"""{POOL},
checks AS (SELECT s.series, p.number, count(h.number) AS times, count(h.number) FILTER (h.draw_idx >= h.n_draws - 12) AS recent,
    max(h.draw_date) AS last_date FROM (SELECT DISTINCT series FROM dd) s CROSS JOIN pool p
    LEFT JOIN hits h ON h.series = s.series AND h.number = p.number GROUP BY 1, 2)"""
ORACLE["recent_12_top"] = recent_top(12, 8)
ORACLE["recent_52_top"] = recent_top(52, 10)
ORACLE["latest_draw"] = with_(WEEKLY) + "SELECT series, draw_date, numbers FROM dr WHERE draw_idx = n_draws - 1"
ORACLE["number_check"] = with_(WEEKLY, CHECKS) + "SELECT * FROM checks"
ORACLE["ticket_check"] = with_(DAILY, SCORES, tickets("scores", ("integrated",), 6, f"draw_idx = n_draws AND n_draws >= {HISTORY_WINDOW}"),
                               CHECKS.split(",\n", 1)[1]) + """
SELECT c.* FROM checks c JOIN tk ON tk.series = c.series AND list_contains(tk.ticket_nums, c.number)"""
ORACLE["stats_cards"] = with_(WEEKLY, FREQ, SERIAL, """
fit AS (SELECT series, sum((occurrences - expected) * (occurrences - expected) / expected) AS x2, min(occurrences) AS lo, max(occurrences) AS hi
    FROM freq GROUP BY 1),
zz AS (SELECT *, (pow(x2 / 89, 1::DOUBLE / 3) - (1 - 2::DOUBLE / 801)) / sqrt(2::DOUBLE / 801) AS z FROM fit),
tt AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t, 0.3989423::DOUBLE * exp(-z * z / 2) AS d FROM zz),
pp AS (SELECT *, d * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS p FROM tt),
rec AS (SELECT series, any_value(n_draws) AS n, count(DISTINCT draw_idx) AS m, count(DISTINCT number) AS k, sum(number) AS s,
    count(*) FILTER (number % 2 = 0) AS e FROM hits WHERE draw_idx >= n_draws - 52 GROUP BY 1),
ov AS (SELECT series, sum(shared) AS shared FROM shared JOIN dd USING (series, draw_idx) WHERE draw_idx > n_draws - 52 GROUP BY 1)""") + """
SELECT series, CAST(n AS BIGINT) AS draws, k AS distinct_numbers, round(s / m::DOUBLE, 8) AS mean_sum, 227.5::DOUBLE AS expected_sum, round(e / m::DOUBLE, 8) AS mean_evens,
round(shared / greatest(1, m - 1)::DOUBLE, 8) AS mean_overlap, round(x2, 8) AS chi_square,
abs(round(greatest(0.0, least(1.0, CASE WHEN z >= 0 THEN p ELSE 1 - p END)), 8)) AS approximate_p, lo AS min_count, hi AS max_count
FROM rec JOIN pp USING (series) JOIN ov USING (series)"""
ORACLE["audit_tests"] = with_(DAILY, FREQ, SERIAL_TEST, """
fit AS (SELECT series, sum((occurrences - expected) * (occurrences - expected) / expected) AS x2 FROM freq GROUP BY 1),
zz AS (SELECT *, (pow(x2 / 89, 1::DOUBLE / 3) - (1 - 2::DOUBLE / 801)) / sqrt(2::DOUBLE / 801) AS z FROM fit),
tt AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t, 0.3989423::DOUBLE * exp(-z * z / 2) AS d FROM zz),
pp AS (SELECT *, d * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS p FROM tt),
tests AS (SELECT series, 'marginal_frequency' AS test, x2 AS statistic, greatest(0.0, least(1.0, CASE WHEN z >= 0 THEN p ELSE 1 - p END)) AS raw_p FROM pp
    UNION ALL SELECT series, 'serial_overlap', k::DOUBLE, p_value FROM tot JOIN pv USING (series)),
steps AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY raw_p) - 1 AS step, count(*) OVER (PARTITION BY series) AS m FROM tests)""") + """
SELECT series, test, round(statistic, 7) AS statistic, round(raw_p, 7) AS raw_p,
round(max(least(1.0, (m - step) * raw_p)) OVER (PARTITION BY series ORDER BY raw_p ROWS UNBOUNDED PRECEDING), 7) AS holm_p FROM steps"""
ORACLE["header_cards"] = with_(DAILY) + f"""SELECT series, count(*) AS draws, min(draw_date) AS first_date, max(draw_date) AS last_date,
least({FORWARD_TARGET}, greatest(0, count(*) - {HISTORY_WINDOW})) AS processed, {FORWARD_TARGET} AS target FROM dd GROUP BY 1"""

# ---------------------------------------------------------------------- statistics

ORACLE["order_statistics"] = """WITH s AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), p AS (SELECT unnest([0.05, 0.3, 0.5, 0.95])::DOUBLE AS probability)
SELECT l_returnflag, probability, l_extendedprice AS quantile, 'n_minus_one' AS rule FROM s, p WHERE i = CAST(floor((n - 1) * probability) AS BIGINT)
UNION ALL SELECT l_returnflag, probability, l_extendedprice, 'n' FROM s, p WHERE i = CAST(floor(n * probability) AS BIGINT)"""
ORACLE["empirical_tails"] = """SELECT l_returnflag, n AS replicates, round((below + 1) / (n + 1)::DOUBLE, 9) AS lower_p,
round((above + 1) / (n + 1)::DOUBLE, 9) AS upper_p, round(least(1.0, 2 * least(below + 1, above + 1) / (n + 1)::DOUBLE), 9) AS two_sided_p FROM (
SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_extendedprice <= 20000 + 1e-12) AS below, count(*) FILTER (l_extendedprice >= 20000 - 1e-12) AS above
FROM lineitem GROUP BY 1)"""
ORACLE["prng_uniforms"] = with_("ev AS (SELECT event_id, event_id AS pos FROM events)", uniforms(AUDIT_SEED, "ev")) + "SELECT event_id, u AS uniform FROM un"
ORACLE["random_tickets"] = with_(random_tickets(AUDIT_SEED, "o_orderkey", "orders", "o_orderkey")) + "SELECT o_orderkey, ticket FROM rt"

# -------------------------------------------------------------------------- ledger

LEDGER_START = HISTORY_WINDOW
ORACLE["forward_ledger"] = with_(
    DAILY, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx >= {LEDGER_START} AND draw_idx < {LEDGER_START + FORWARD_TARGET} AND draw_idx < n_draws"),
    random_tickets(FORWARD_SEED, "series, draw_idx", f"(SELECT * FROM dd WHERE draw_idx BETWEEN {LEDGER_START} AND {LEDGER_START + FORWARD_TARGET - 1})",
                   f"draw_idx - {LEDGER_START}"), """
held AS (SELECT series, draw_idx, method, ticket, ticket_nums FROM tk UNION ALL SELECT series, draw_idx, 'random', ticket, ticket_nums FROM rt),
led AS (SELECT h.*, d.draw_date, d.numbers, b.bonus, CAST(len(list_intersect(h.ticket_nums, d.nums)) AS INTEGER) AS mh
    FROM held h JOIN dr d ON d.series = h.series AND d.draw_idx = h.draw_idx LEFT JOIN bonus b ON b.series = d.series AND b.draw_date = d.draw_date)""") + f"""
SELECT series, draw_date, draw_idx + 1 AS contest, method, ticket AS prediction, numbers AS actual, bonus, mh AS main_hits,
CASE WHEN mh = 5 AND list_contains(ticket_nums, bonus) THEN '5+1' ELSE CAST(mh AS VARCHAR) END AS category, 1 AS stake,
CASE WHEN mh < 2 THEN 0 END AS gross_return, CASE WHEN mh < 2 THEN -1 END AS net_profit,
CASE WHEN mh < 2 THEN 'NO_MAIN_PRIZE' ELSE 'PENDING_OFFICIAL_QUOTA' END AS payout_status, draw_idx - {LEDGER_START - 1} AS processed_draws,
CASE WHEN draw_idx - {LEDGER_START - 1} >= {FORWARD_TARGET} THEN 'COMPLETE' ELSE 'ACTIVE' END AS status FROM led"""
ORACLE["forward_next"] = with_(
    DAILY, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx = n_draws AND n_draws >= {LEDGER_START}"),
    random_tickets(FORWARD_SEED, "series, n_draws", "(SELECT DISTINCT series, n_draws FROM dd)", f"n_draws - {LEDGER_START}")) + """
SELECT i.series, i.draw_idx, i.ticket AS integrated_ticket, f.ticket AS frequency52_ticket, rt.ticket AS random_ticket
FROM tk i JOIN tk f USING (series, draw_idx) JOIN rt ON rt.series = i.series WHERE i.method = 'integrated' AND f.method = 'frequency52'"""

FIRST_VALID = RAW + """,
firsts AS (SELECT coalesce(source, '(none)') AS series, draw_date, nums, numbers, bonus, source_ord % 90 + 1 AS superstar, row_number() OVER (PARTITION BY source, draw_date ORDER BY source_ord) AS r
    FROM chk WHERE numbers_ok AND bonus_ok),
dr AS (SELECT series, draw_date, nums, numbers, bonus, superstar, CAST(row_number() OVER (PARTITION BY series ORDER BY draw_date) - 1 AS INTEGER) AS draw_idx,
    CAST(count(*) OVER (PARTITION BY series) AS INTEGER) AS n_draws FROM firsts WHERE r = 1),
dd AS (SELECT series, draw_date, draw_idx, n_draws FROM dr),
hits AS (SELECT series, draw_idx, n_draws, draw_date, unnest(nums) AS number FROM dr)"""
LONG_ENOUGH = f"n_draws >= {HISTORY_WINDOW + 2}"
OPENED = f"greatest({HISTORY_WINDOW}, n_draws - {FORWARD_TARGET})"  # the first draw of a derived ledger
SHORT = f""",
short AS (SELECT series, coalesce(n, 0) AS n FROM (SELECT DISTINCT coalesce(o_orderpriority, '(none)') AS series FROM orders)
    LEFT JOIN (SELECT series, count(*) AS n FROM dd GROUP BY 1) USING (series) WHERE coalesce(n, 0) < {HISTORY_WINDOW + 2})"""
ORACLE["ledger_advance"] = with_(
    FIRST_VALID + SHORT, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx >= {OPENED} AND {LONG_ENOUGH}"),
    random_tickets(FORWARD_SEED, "series, draw_idx, n_draws", f"""(SELECT DISTINCT series, draw_idx, n_draws FROM steps
    WHERE draw_idx >= n_draws - 1 AND {LONG_ENOUGH})""", f"draw_idx - {OPENED}")) + f"""
SELECT d.series, 'PROCESSED' AS outcome, CASE WHEN d.n_draws - {OPENED} >= {FORWARD_TARGET} THEN 'COMPLETE' ELSE 'ACTIVE' END AS status,
d.n_draws - {OPENED} AS processed_draws, d.n_draws - {OPENED} AS n_results, d.n_draws - {OPENED} AS baseline_processed, d.n_draws - {OPENED} AS baseline_results,
CAST(d.draw_date AS VARCHAR) AS last_processed, d.n_draws AS contest, i.ticket AS integrated_ticket, i.hits AS integrated_hits,
CASE WHEN i.hits = 5 AND list_contains(i.ticket_nums, d.bonus) THEN '5+1' ELSE CAST(i.hits AS VARCHAR) END AS integrated_category,
CASE WHEN i.hits < 2 THEN -1 END AS integrated_profit, f.hits AS frequency52_hits,
CAST(len(list_intersect(r.ticket_nums, d.nums)) AS INTEGER) AS random_hits,
CAST((SELECT sum(hits) FROM tk WHERE tk.series = d.series AND tk.method = 'integrated' AND tk.draw_idx < d.n_draws) AS INTEGER) AS hits_so_far,
ni.ticket AS next_integrated, nf.ticket AS next_frequency52, nf.ticket AS next_copy, nr.ticket AS next_random
FROM dr d JOIN tk i ON i.series = d.series AND i.draw_idx = d.draw_idx AND i.method = 'integrated'
JOIN tk f ON f.series = d.series AND f.draw_idx = d.draw_idx AND f.method = 'frequency52'
JOIN rt r ON r.series = d.series AND r.draw_idx = d.draw_idx
JOIN tk ni ON ni.series = d.series AND ni.draw_idx = d.n_draws AND ni.method = 'integrated'
JOIN tk nf ON nf.series = d.series AND nf.draw_idx = d.n_draws AND nf.method = 'frequency52'
JOIN rt nr ON nr.series = d.series AND nr.draw_idx = d.n_draws WHERE d.draw_idx = d.n_draws - 1
UNION ALL BY NAME SELECT series, 'HISTORY_SHORT' AS outcome FROM short""".replace(OPENED, OPENED.replace("n_draws", "d.n_draws"))
FROZEN = with_(
    FIRST_VALID + SHORT, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx BETWEEN {OPENED} AND n_draws - 1 AND {LONG_ENOUGH}"),
    random_tickets(FORWARD_SEED, "series, draw_idx, n_draws", f"(SELECT * FROM dd WHERE draw_idx >= {OPENED} AND {LONG_ENOUGH})", f"draw_idx - {OPENED}"), """
froz AS (SELECT series, draw_idx, method, ticket, ticket_nums FROM tk UNION ALL SELECT series, draw_idx, 'random', ticket, ticket_nums FROM rt),
met AS (SELECT z.series, z.draw_idx, d.n_draws, method, ticket, ticket_nums, d.numbers, d.nums, d.bonus, d.superstar,
    list_filter(ticket_nums, lambda x: list_contains(d.nums, x)) AS both_nums FROM froz z JOIN dr d ON d.series = z.series AND d.draw_idx = z.draw_idx)""")
ORACLE["saved_predictions"] = FROZEN + """
SELECT series, 'MATCHED' AS outcome, method, ticket, numbers, array_to_string(both_nums, ',') AS hits, CAST(len(both_nums) AS INTEGER) AS hit_count,
CAST(sum(len(both_nums)) OVER (PARTITION BY method) AS BIGINT) AS method_total, list_contains(ticket_nums, bonus) AS bonus_hit,
list_contains(ticket_nums, superstar) AS superstar_hit FROM met WHERE draw_idx = n_draws - 1
UNION ALL BY NAME SELECT series, 'HISTORY_SHORT' AS outcome FROM short"""
ORACLE["ledger_cards"] = FROZEN + f"""
SELECT series, CAST(any_value(n_draws) - 1 AS BIGINT) AS draws, any_value(n_draws - 1 - {OPENED}) || '/{FORWARD_TARGET}' AS progress,
arg_max(method, h * 10 - list_position(['integrated', 'frequency52', 'random'], method)) AS best_method, CAST(max(h) AS INTEGER) AS best_hits
FROM (SELECT series, method, any_value(n_draws) AS n_draws, sum(len(both_nums)) AS h FROM met WHERE draw_idx < n_draws - 1 GROUP BY 1, 2) GROUP BY 1
UNION ALL BY NAME SELECT series, n AS draws, '0/{FORWARD_TARGET}' AS progress FROM short"""
ORACLE["ledger_violations"] = with_(FIRST_VALID + SHORT) + f"""
SELECT series, variant, outcome FROM (SELECT DISTINCT series FROM dd WHERE {LONG_ENOUGH}), (VALUES
('number_repeated', 'INVALID_DRAW'), ('jolly_drawn', 'INVALID_DRAW'), ('superstar_missing', 'INVALID_DRAW'), ('no_calendar_day', 'INVALID_DRAW'),
('known_equal', 'ALREADY_PROCESSED'), ('known_changed', 'CONFLICT'), ('contest_skipped', 'CONTEST'), ('date_early', 'ALIGNMENT'),
('counter_off', 'COUNTERS'), ('target_reached', 'COUNTERS'), ('windows_changed', 'PROTOCOL'), ('look_ahead', 'PROTOCOL'),
('ticket_changed', 'PREDICTIONS'), ('copy_changed', 'PREDICTIONS'), ('random_changed', 'RANDOM'), ('history_short', 'ALIGNMENT')) AS v(variant, outcome)
UNION ALL BY NAME SELECT series, 'HISTORY_SHORT' AS outcome FROM short"""
ORACLE["stream_ledger"] = with_(
    FIRST_VALID, SCORES, tickets("scores", ("integrated", "frequency52"), 6,
                                 f"draw_idx >= {LEDGER_START} AND draw_idx < {LEDGER_START + FORWARD_TARGET} AND draw_idx < n_draws"),
    random_tickets(FORWARD_SEED, "series, draw_idx", f"(SELECT * FROM dd WHERE draw_idx BETWEEN {LEDGER_START} AND {LEDGER_START + FORWARD_TARGET - 1})",
                   f"draw_idx - {LEDGER_START}"), """
held AS (SELECT series, draw_idx, method, ticket, ticket_nums FROM tk UNION ALL SELECT series, draw_idx, 'random', ticket, ticket_nums FROM rt),
content AS (SELECT source AS series, draw_date, numbers, bonus, source_ord % 90 AS superstar, count(*) AS n, min(source_ord) AS ord,
    bool_and(numbers_ok AND bonus_ok) AS ok FROM chk GROUP BY 1, 2, 3, 4, 5),
placed AS (SELECT c.*, d.draw_idx, row_number() OVER (PARTITION BY c.series, c.draw_date, ok ORDER BY ord) AS nth
    FROM content c LEFT JOIN dd d ON d.series = c.series AND d.draw_date = c.draw_date)""") + f"""
SELECT series, draw_date, CAST(NULL AS INTEGER) AS contest, outcome, times, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS VARCHAR) AS prediction,
numbers AS actual, bonus, CAST(NULL AS INTEGER) AS main_hits, CAST(NULL AS INTEGER) AS processed_draws, CAST(NULL AS VARCHAR) AS status FROM (
SELECT *, unnest(CASE WHEN NOT ok THEN [{{'outcome': 'INVALID', 'times': n}}]
    WHEN draw_idx >= {LEDGER_START + FORWARD_TARGET} THEN [{{'outcome': 'TARGET_REACHED', 'times': n}}]
    WHEN nth > 1 THEN [{{'outcome': 'CONFLICT', 'times': n}}]
    WHEN draw_idx < {LEDGER_START} AND n > 1 THEN [{{'outcome': 'HISTORY', 'times': n}}, {{'outcome': 'REPEATED', 'times': n - 1}}]
    WHEN draw_idx < {LEDGER_START} THEN [{{'outcome': 'HISTORY', 'times': n}}]
    WHEN n > 1 THEN [{{'outcome': 'REPEATED', 'times': n - 1}}] ELSE [] END, recursive := true) FROM placed)
UNION ALL
SELECT d.series, d.draw_date, NULL, 'SCORED', p.n, h.method, h.ticket AS prediction, d.numbers AS actual, d.bonus,
CAST(len(list_intersect(h.ticket_nums, d.nums)) AS INTEGER) AS main_hits, d.draw_idx - {LEDGER_START - 1} AS processed_draws,
CASE WHEN d.draw_idx - {LEDGER_START - 1} >= {FORWARD_TARGET} THEN 'COMPLETE' ELSE 'ACTIVE' END AS status
FROM held h JOIN dr d ON d.series = h.series AND d.draw_idx = h.draw_idx
JOIN placed p ON p.series = d.series AND p.draw_date = d.draw_date AND p.ok AND p.nth = 1"""

# ---------------------------------------------------------------- text and documents

SPACE = "[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
STRIPPED = "regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g')"


def cleaned(text: str, amp: bool = False) -> str:
    inner = STRIPPED.format(text)
    if amp:
        inner = f"replace({inner}, '&amp;', '&')"
    return f"trim(regexp_replace({inner}, '{SPACE}', ' ', 'g'))"


ORACLE["csv_roundtrip"] = with_(DAILY) + """SELECT CAST(draw_date AS VARCHAR) AS date_text, draw_date, numbers, bonus
FROM dr LEFT JOIN bonus USING (series, draw_date)"""
ORACLE["html_draw_tables"] = with_(WEEKLY) + "SELECT series, draw_date, draw_idx + 1 AS contest, numbers FROM dr"
ORACLE["archive_files"] = with_(DAILY) + """SELECT draw_date, numbers, bonus,
CAST(CASE WHEN year(draw_date) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_rows,
year(draw_date) % 2 = 0 AND bonus IS DISTINCT FROM CASE WHEN list_contains(nums, 90) OR bonus = 90 THEN bonus ELSE 90 END AS conflict
FROM dr LEFT JOIN bonus USING (series, draw_date)"""
ORACLE["prepared_archive"] = ORACLE["draw_series"]
ORACLE["page_files"] = ORACLE["html_draw_tables"]
ORACLE["ledger_files"] = f"""SELECT series, outcome, processed_draws, hits_so_far, next_integrated FROM ({ORACLE["ledger_advance"]})"""
ORACLE["experiment_files"] = FROZEN + f"""
SELECT series, 'again' AS rerun_of, any_value(n_draws - 1 - {OPENED}) AS draws, CAST(sum(len(both_nums)) AS INTEGER) AS hits, 'initialized' AS first_run,
'preserved' AS second_run, 'preserved' AS baseline, true AS history_matches, true AS same_coverage, false AS same_tickets, true AS files_unchanged
FROM met WHERE method = 'integrated' AND draw_idx < n_draws - 1 GROUP BY 1 UNION ALL BY NAME SELECT series, 'HISTORY_SHORT' AS first_run FROM short"""
ORACLE["html_clean"] = f"SELECT page_id, {cleaned('html')} AS text, {cleaned('html', True)} AS text_amp FROM pages"
ORACLE["html_cells"] = f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(block, '(?is)<a[^>]*>(.*?)</a>', 1), lambda c: {cleaned('c')}), ',') AS cells
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li>.*?</li>')) AS block FROM pages)"""
ORACLE["page_lineage"] = "SELECT page_id, url, sha256(html) AS sha256 FROM pages"
ORACLE["json_properties"] = """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""
ORACLE["json_nested"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
ORACLE["decade_counts"] = with_(DAILY) + """SELECT series, CAST((number - 1) // 10 AS INTEGER) AS decade, count(*) AS occurrences
FROM hits GROUP BY 1, 2"""

ORACLE["archive_rejects"] = with_(DAILY) + """SELECT rules, count(*) AS n_rows, true AS refused FROM (
SELECT CASE draw_idx % 11 WHEN 3 THEN 'numbers' WHEN 5 THEN 'date' WHEN 7 THEN 'numbers' WHEN 9 THEN 'bonus,numbers' ELSE '' END AS rules
FROM dr JOIN bonus USING (series, draw_date)) GROUP BY 1"""
ORACLE["archive_without_bonus"] = with_(DAILY) + "SELECT series, draw_idx, n_draws, draw_date, numbers FROM dr"
ORACLE["coverage_audit"] = with_(DAILY) + """SELECT audit, CASE off WHEN 0 THEN 'ACCEPTED' ELSE 'REFUSED' END AS outcome, min(draw_date) AS first_date,
max(draw_date) AS last_date, count(*) + off AS recorded_draws, CASE off WHEN 0 THEN count(*) END AS held_draws
FROM dr, (VALUES ('recorded', 0), ('changed', 1)) AS v(audit, off) GROUP BY audit, off"""
ORACLE["page_hashes"] = with_(WEEKLY, """
html AS (SELECT draw_idx AS page, '<table><tr><th>head</th></tr><TR><td><a href=' || chr(39) || 'estrazione.php?c=' || draw_idx || chr(39) || '>n. '
    || (draw_idx + 1) || '</a></td><td>' || strftime(draw_date, '%d/%m/%Y') || '</td>' || string_agg('<td class=' || chr(39) || 'n' || chr(39) || '>' || chr(10)
    || array_to_string(['<b>' || n || '</b>' FOR n IN nums], '&nbsp;') || '</td>', '' ORDER BY series) || '</TR></table>' || chr(10) AS text
    FROM dr GROUP BY draw_idx, draw_date)""") + """
SELECT page, sha256(text) AS sha256, true AS staged_as_recorded, page < max(page) OVER () AS changed_as_recorded FROM html"""
ORACLE["update_receipts"] = with_(FIRST_VALID + SHORT) + f"""
SELECT series, position, outcome, n_draws - {OPENED} - 1 + position AS processed_before, n_draws - {OPENED} AS processed_after, position = 1 AS unchanged
FROM (SELECT DISTINCT series, n_draws FROM dd WHERE {LONG_ENOUGH}), (VALUES (0, 'PROCESSED'), (1, 'ALREADY_PROCESSED')) AS v(position, outcome)
UNION ALL BY NAME SELECT series, 'HISTORY_SHORT' AS outcome FROM short"""
ORACLE["summary_lines"] = with_(WEEKLY) + """SELECT '{"series":"' || series || '","draws":' || count(*) || ',"first":"' || min(draw_date) || '","last":"'
|| max(draw_date) || '","note":null}' AS line FROM dr GROUP BY series"""
ORACLE["dated_predictions"] = with_(DAILY, SCORES, tickets("scores", ("integrated", "frequency52"), 6, f"draw_idx >= {HISTORY_WINDOW}"), """
frozen AS (SELECT tk.series, d.draw_date - early AS saved_on, tk.method || '_ticket' || CASE early WHEN 0 THEN '' ELSE '_early' END AS method, ticket, ticket_nums
    FROM tk JOIN dd d ON d.series = tk.series AND d.draw_idx = tk.draw_idx - 1, (SELECT unnest([0, 10])::INTEGER AS early))""") + """
SELECT f.series, method, saved_on, ticket, dr.draw_date, dr.numbers, CASE WHEN dr.draw_date IS NOT NULL THEN CAST(len(list_intersect(ticket_nums, nums)) AS INTEGER) END AS hit_count
FROM frozen f ASOF LEFT JOIN dr ON f.series = dr.series AND f.saved_on < dr.draw_date"""
