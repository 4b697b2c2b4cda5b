"""Geocentric ecliptic longitudes and Moon phase per calendar day, as DataFrame columns.

Planets use the published approximate Keplerian elements for 1800-2050 (Standish), Kepler's equation by
Newton steps; the Moon uses the largest periodic terms of the published lunar series. Accuracy is a few
arc minutes, enough for 30 and 45 degree bins away from their edges. Bodies are rows, so every formula is
written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions.columns import angle_bin, aspect_bin, draw_instant, wrap_degrees

# Elements at J2000 and their rates per century, in the order
# semi-major axis (au), eccentricity, inclination, mean longitude, longitude of perihelion, node (degrees).
ELEMENTS = {
    "Mercury": (0.38709927, 0.00000037, 0.20563593, 0.00001906, 7.00497902, -0.00594749,
                252.25032350, 149472.67411175, 77.45779628, 0.16047689, 48.33076593, -0.12534081),
    "Venus": (0.72333566, 0.00000390, 0.00677672, -0.00004107, 3.39467605, -0.00078890,
              181.97909950, 58517.81538729, 131.60246718, 0.00268329, 76.67984255, -0.27769418),
    "Earth": (1.00000261, 0.00000562, 0.01671123, -0.00004392, -0.00001531, -0.01294668,
              100.46457166, 35999.37244981, 102.93768193, 0.32327364, 0.0, 0.0),
    "Mars": (1.52371034, 0.00001847, 0.09339410, 0.00007882, 1.84969142, -0.00813131,
             -4.55343205, 19140.30268499, -23.94362959, 0.44441088, 49.55953891, -0.29257343),
    "Jupiter": (5.20288700, -0.00011607, 0.04838624, -0.00013253, 1.30439695, -0.00183714,
                34.39644051, 3034.74612775, 14.72847983, 0.21252668, 100.47390909, 0.20469106),
    "Saturn": (9.53667594, -0.00125060, 0.05386179, -0.00050991, 2.48599187, 0.00193609,
               49.95424423, 1222.49362201, 92.59887831, -0.41897216, 113.66242448, -0.28867794),
    "Uranus": (19.18916464, -0.00196176, 0.04725744, -0.00004397, 0.77263783, -0.00242939,
               313.23810451, 428.48202785, 170.95427630, 0.40805281, 74.01692503, 0.04240589),
    "Neptune": (30.06992276, 0.00026291, 0.00859048, 0.00005105, 1.77004347, 0.00035372,
                -55.12002969, 218.45945325, 44.96476227, -0.32241464, 131.78422574, -0.00508664),
}
# General precession in longitude, degrees per century.
PRECESSION = 1.396971
# Lunar longitude terms (degrees; multiples of elongation, solar anomaly, lunar anomaly, latitude argument).
MOON_TERMS = (
    (6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0),
    (-0.185116, 0, 1, 0, 0), (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0), (0.057066, 2, -1, -1, 0),
    (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0), (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0),
    (-0.030383, 0, 1, 1, 0), (0.015327, 2, 0, 0, -2),
)
# Linear lunar arguments at J2000 and per century (mean longitude, D, M, M', F).
MOON_ARGUMENTS = ((218.3164477, 481267.88123421), (297.8501921, 445267.1114034), (357.5291092, 35999.0502909),
                  (134.9633964, 477198.8675055), (93.2720950, 483202.0175233))
KEPLER_STEPS = 5
BODIES = ("Sun", "Mercury", "Venus", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune")


def centuries(day: Column, instant: Column) -> Column:
    """Julian centuries since J2000 noon of a UTC instant on ``day``."""
    days = F.date_diff(day, F.lit("2000-01-01").cast("date")) + F.hour(instant) / 24.0 - 0.5
    return days / 36525.0


def angles(days: DataFrame) -> DataFrame:
    """``draw_date, utc`` and one longitude column per body plus MoonPhase, for distinct dates."""
    # as text: hundreds of literals are one expression to parse instead of hundreds of objects to build
    listed = ", ".join(f"named_struct('body', '{name}', " + ", ".join(f"'v{i}', {v!r}D" for i, v in enumerate(values)) + ")" for name, values in ELEMENTS.items())
    body_rows = F.expr(f"explode(array({listed}))")
    instants = days.select("draw_date", draw_instant(F.col("draw_date")).alias("utc"))
    timed = instants.withColumn("t", centuries(F.col("draw_date"), F.col("utc")))
    rows = timed.select("draw_date", "utc", "t", body_rows.alias("b"))

    def element(i: int) -> Column:
        return F.col(f"b.v{2 * i}") + F.col(f"b.v{2 * i + 1}") * F.col("t")

    orbit = rows.select(
        "draw_date", "utc", "t", F.col("b.body").alias("body"), element(0).alias("a"), element(1).alias("e"),
        F.radians(element(2)).alias("incl"), F.radians(wrap_degrees(element(3) - element(4))).alias("anomaly"),
        F.radians(element(4) - element(5)).alias("peri"), F.radians(element(5)).alias("node"))
    orbit = orbit.withColumn("ecc", F.col("anomaly") + F.col("e") * F.sin("anomaly"))
    for _ in range(KEPLER_STEPS):
        orbit = orbit.withColumn("ecc", F.col("ecc") - (F.col("ecc") - F.col("e") * F.sin("ecc") - F.col("anomaly"))
                                 / (1 - F.col("e") * F.cos("ecc")))
    plane = orbit.withColumn("p", F.col("a") * (F.cos("ecc") - F.col("e"))).withColumn(
        "q", F.col("a") * F.sqrt(1 - F.col("e") * F.col("e")) * F.sin("ecc"))
    cp, sp, cn, sn, ci = F.cos("peri"), F.sin("peri"), F.cos("node"), F.sin("node"), F.cos("incl")
    space = plane.select(
        "draw_date", "utc", "t", "body",
        ((cp * cn - sp * sn * ci) * F.col("p") + (-sp * cn - cp * sn * ci) * F.col("q")).alias("x"),
        ((cp * sn + sp * cn * ci) * F.col("p") + (-sp * sn + cp * cn * ci) * F.col("q")).alias("y"))

    def of(body: str, axis: str) -> Column:
        return F.max(F.when(F.col("body") == body, F.col(axis)))

    wide = space.groupBy("draw_date", "utc", "t").agg(
        *[of(b, axis).alias(f"{axis}_{b}") for b in ELEMENTS for axis in ("x", "y")])

    def longitude(body: str) -> Column:
        x, y = -F.col("x_Earth"), -F.col("y_Earth")
        if body != "Sun":
            x, y = F.col(f"x_{body}") + x, F.col(f"y_{body}") + y
        return wrap_degrees(F.degrees(F.atan2(y, x)) + PRECESSION * F.col("t"))

    located = wide.select("draw_date", "utc", "t", *[longitude(b).alias(b) for b in BODIES])
    return located.withColumn("MoonPhase", wrap_degrees(_moon_longitude("t") - F.col("Sun"))).drop("t")


def _moon_longitude(t: str) -> Column:
    mean, *arguments = [f"({start!r}D + {rate!r}D * {t})" for start, rate in MOON_ARGUMENTS]
    total = mean
    for amplitude, *multiples in MOON_TERMS:
        phase = " + ".join(["0D", *[f"{m} * {a}" for m, a in zip(multiples, arguments) if m]])
        total += f" + {amplitude!r}D * sin(radians({phase}))"
    return F.expr(total)


def bins(located: DataFrame) -> DataFrame:
    """Replace longitudes by feature bins: 45 degrees for the phase, 30 for bodies, five aspect classes."""
    return located.select(
        "draw_date", angle_bin(F.col("MoonPhase"), 45).alias("MoonPhase"),
        *[angle_bin(F.col(b), 30).alias(b) for b in BODIES],
        aspect_bin(F.col("Mercury"), F.col("Venus")).alias("MercuryVenusAspect"))


def date_bins(days: DataFrame) -> DataFrame:
    """Bins of the distinct dates in ``draw_date`` (bounded by the calendar, whatever the number of series)."""
    return bins(angles(days.select("draw_date").distinct()))
