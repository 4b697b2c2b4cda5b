"""Column expressions used by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawstat.settings import Game

# ---------------------------------------------------------------- validation


def valid_date(text: Column) -> Column:
    """ISO text that names a real calendar day (2026-02-30 is refused)."""
    return F.coalesce(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(),
        F.lit(False),
    )


def whole_in_range(value: Column, pool: int) -> Column:
    """Integer between 1 and ``pool``; NULL and fractions are refused."""
    return F.coalesce((value == F.floor(value)) & value.between(1, pool), F.lit(False))


def valid_numbers(numbers: Column, game: Game) -> Column:
    return F.coalesce(
        (F.size(numbers) == game.pick)
        & (F.size(F.array_distinct(numbers)) == game.pick)
        & F.forall(numbers, lambda n: whole_in_range(n, game.pool)),
        F.lit(False),
    )


def valid_bonus(bonus: Column, numbers: Column, game: Game) -> Column:
    """The bonus number must differ from every drawn number."""
    return whole_in_range(bonus, game.pool) & ~F.coalesce(F.array_contains(numbers, bonus), F.lit(False))


# ------------------------------------------------------------- combinatorics


def choose(n: Column | int, k: Column | int) -> Column:
    """Binomial coefficient as a double, 0 outside ``0 <= k <= n``."""
    n_col = (F.lit(n) if isinstance(n, int) else n).cast("double")
    k_col = (F.lit(k) if isinstance(k, int) else k).cast("int")
    steps = F.when(k_col >= 1, F.sequence(F.lit(1), k_col)).otherwise(F.array().cast("array<int>"))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n_col - k_col + i) / i)
    return F.when((k_col < 0) | (k_col > n_col), F.lit(0.0)).otherwise(product)


def overlap_at_least_two(game: Game) -> Column:
    rest = game.pool - game.pick
    return 1 - (choose(rest, game.pick) + game.pick * choose(rest, game.pick - 1)) / choose(game.pool, game.pick)


# -------------------------------------------------------------------- tickets


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def decade_of(number: Column, game: Game) -> Column:
    return F.floor((number - 1) / game.decade).cast("int")


def ticket_text(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), ",")


def horizon_z(count: Column, window: int, game: Game) -> Column:
    """Binomial z-score of a count over ``window`` draws."""
    p = game.hit_probability
    return (count - F.lit(window * p)) / F.lit((window * p * (1 - p)) ** 0.5)


def prize_category(hits: Column, prediction: Column, bonus: Column) -> Column:
    return F.when((hits == 5) & F.array_contains(prediction, bonus), F.lit("5+1")).otherwise(hits.cast("string"))


def gross_return(hits: Column) -> Column:
    """0 without a prize; NULL until the official quota is known."""
    return F.when(hits < 2, F.lit(0))


def net_profit(hits: Column, stake: Column) -> Column:
    return F.when(hits < 2, -stake)


# The two states of a payout.
def payout_status(hits: Column) -> Column:
    return F.when(hits < 2, F.lit("NO_MAIN_PRIZE")).otherwise(F.lit("PENDING_OFFICIAL_QUOTA"))


# ---------------------------------------------------------------- approximations

# Polynomial coefficients of the Abramowitz-Stegun normal tail (26.2.17, rounded).
_TAIL_T = 0.2316419
_TAIL_DENSITY = 0.3989423
_TAIL_POLY = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def normal_tail(z: Column) -> Column:
    """Upper normal tail by the five-term polynomial."""
    t = 1 / (1 + _TAIL_T * F.abs(z))
    poly = F.lit(_TAIL_POLY[-1])
    for coefficient in reversed(_TAIL_POLY[:-1]):
        poly = coefficient + t * poly
    tail = _TAIL_DENSITY * F.exp(-z * z / 2) * t * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi_square_tail(statistic: Column, degrees: int = 89) -> Column:
    """Wilson-Hilferty upper tail of a chi-square statistic, clamped to [0, 1]."""
    spread = 2 / (9 * degrees)
    z = (F.pow(statistic / degrees, F.lit(1 / 3)) - (1 - spread)) / F.lit(spread**0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal_tail(z)))


# ------------------------------------------------------------- time and angles


def draw_instant(day: Column, hour: int = 20, zone: str = "Europe/Rome") -> Column:
    """UTC wall clock (no zone) of the nominal local draw hour."""
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(0), F.lit(0))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def wrap_degrees(angle: Column) -> Column:
    """Into [0, 360). A tiny negative angle rounds up to 360 and is the same direction as 0."""
    wrapped = angle - 360 * F.floor(angle / 360)
    return F.when(wrapped >= 360, F.lit(0.0)).otherwise(wrapped)


def angle_bin(angle: Column, width: int) -> Column:
    return F.pmod(F.floor(angle / width), F.lit(360 // width)).cast("int")


def aspect_bin(first: Column, second: Column) -> Column:
    """Index of the first aspect (0, 90, 120, 180 degrees) within 6 degrees of the separation, else 4."""
    difference = F.abs(first - second) % 360
    separation = F.least(difference, 360 - difference)
    index = F.lit(4)
    for position, angle in reversed(list(enumerate((0, 90, 120, 180)))):
        index = F.when(F.abs(separation - angle) <= 6, F.lit(position)).otherwise(index)
    return index


# ------------------------------------------------------------------------ text

# White space as in ECMAScript: ASCII controls plus the Unicode space separators.
SPACE_CLASS = "[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def clean_html(html: Column, unescape_amp: bool = False) -> Column:
    """Tags and no-break spaces become blanks, runs of white space one blank, ends trimmed."""
    # The patterns of tags, no-break spaces and the ampersand.
    text = F.regexp_replace(html, "<[^>]*>", " ")
    text = F.regexp_replace(text, "&nbsp;|&#160;", " ")
    if unescape_amp:
        text = F.regexp_replace(text, "&amp;", "&")
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def iso_from_slashes(text: Column) -> Column:
    """``dd/mm/yyyy`` to a date, NULL when it is not a calendar day."""
    return F.try_to_date(text, "dd/MM/yyyy")
