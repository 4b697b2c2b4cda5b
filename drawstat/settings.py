"""Parameters of a draw game and of the published experiments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Game:
    """``pick`` distinct numbers out of ``1..pool``; tickets take at most ``cap`` per ``decade``."""

    pool: int = 90
    pick: int = 6
    cap: int = 3
    decade: int = 10

    @property
    def hit_probability(self) -> float:
        return self.pick / self.pool

    @property
    def expected_hits(self) -> float:
        """Mean hits of any ticket against one uniform draw."""
        return self.pick * self.pick / self.pool


SINGLE_GAME = Game()
WHEEL_GAME = Game(pick=5)

# Experiment parameters that decide the published results.
HORIZONS = (12, 52, 104, 208)
BASELINE_WINDOW = 52
HISTORY_WINDOW = 208
SHRINKAGE_DRAWS = 30
AUDIT_SEED = 20260929
FORWARD_SEED = 20260930
SHIFT_SEED = 20261002
WHEEL_SHIFT_SEED = 20261003
VERIFY_SEED_MASK = 0xA5A5A5A5
PAIR_SEED_MASK = 0x3C3C3C3C
SHIFT_REPLICATES = 199
WHEEL_SHIFT_REPLICATES = 99
NULL_REPLICATES = 20000
PAIR_REPLICATES = 10000
FORWARD_TARGET = 100
MOST_BINS = 12

# Features of each date-conditioned model, in scoring order.
BINNED_MODELS: dict[str, tuple[str, ...]] = {
    "moon_phase_8": ("MoonPhase",),
    "sun_sector_12": ("Sun",),
    "inner_planets_12": ("Mercury", "Venus", "Mars"),
    "outer_planets_12": ("Jupiter", "Saturn", "Uranus", "Neptune"),
    "mercury_venus_aspect": ("MercuryVenusAspect",),
}
FEATURES: tuple[str, ...] = tuple(f for features in BINNED_MODELS.values() for f in features)

# Column headers of a draw archive, link text that marks a draw row of the multi-series pages,
# and the series names of those pages.
ARCHIVE_DATE = "data"
ARCHIVE_BONUS = "jolly"
PAGE_LINK = "estrazione.php"
PAGE_SERIES = ("Bari", "Cagliari", "Firenze", "Genova", "Milano", "Napoli", "Palermo", "Roma",
               "Torino", "Venezia", "Nazionale")
