"""Seeded 32-bit generators.

The counter form of the first generator is a pure function of (seed, position), so every row
computes its own uniforms; it is written with 64-bit columns masked to 32 bits.
The numpy forms serve the replica simulations, where each task owns a range of replicas.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from drawstat.settings import Game

# Fixed value: the increment of the counter generator.
INCREMENT = 0x6D2B79F5
_MASK = 0xFFFFFFFF


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _multiply32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product; the 16-bit split keeps ANSI arithmetic from overflowing."""
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)
    return (high + a.bitwiseAND(0xFFFF) * b).bitwiseAND(_MASK)


def uniform_at(seed: int | Column, position: Column) -> Column:
    """Uniform in [0, 1) at a zero-based stream position. A column of seeds gives every row its own stream."""
    seed_col = (F.lit(seed & _MASK) if isinstance(seed, int) else seed).cast("bigint").bitwiseAND(_MASK)
    # positions enter modulo 2**32, so the product with the increment cannot overflow a bigint
    counter = (position.cast("bigint") + 1).bitwiseAND(_MASK)
    start = (seed_col + _multiply32(counter, F.lit(INCREMENT).cast("bigint"))).bitwiseAND(_MASK)

    def second(v: Column) -> Column:
        mixed = _multiply32(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(61))
        return v.bitwiseXOR((v + mixed).bitwiseAND(_MASK))

    first = _bind(start, lambda v: _multiply32(v.bitwiseXOR(F.shiftright(v, 15)), v.bitwiseOR(1)))
    final = _bind(_bind(first, second), lambda v: v.bitwiseXOR(F.shiftright(v, 14)))
    return final / F.lit(4294967296.0)


def random_ticket(seed: int | Column, draw: Column, game: Game) -> Column:
    """Uniform ticket number ``draw`` of a stream (Floyd's subset sampling, ``pick`` uniforms each)."""
    slots = F.sequence(F.lit(game.pool - game.pick), F.lit(game.pool - 1))

    def add(chosen: Column, slot: Column) -> Column:
        position = draw.cast("bigint") * game.pick + (slot - (game.pool - game.pick))
        candidate = F.floor(uniform_at(seed, position) * (slot + 1)).cast("int")
        return _bind(candidate, lambda c: F.concat(chosen, F.array(F.when(F.array_contains(chosen, c), slot).otherwise(c))))

    zero_based = F.aggregate(slots, F.array().cast("array<int>"), add)
    return F.array_sort(F.transform(zero_based, lambda n: n + 1))


# ---------------------------------------------------------------- numpy forms


def uniforms_at(seed: int, positions: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = ((positions.astype(np.uint64) + 1) * INCREMENT + seed).astype(np.uint32)
        v = (v ^ (v >> 15)) * (v | 1)
        v = v ^ (v + (v ^ (v >> 7)) * (v | 61))
        return (v ^ (v >> 14)) / 4294967296.0


def xorshift_step(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << np.uint32(13))
    state = state ^ (state >> np.uint32(17))
    return state ^ (state << np.uint32(5))


def xorshift_starts(seed: int, replicas: np.ndarray, outputs_per_replica: int) -> np.ndarray:
    """State before the first output of each replica: the generator is linear over GF(2), so the
    jump of ``outputs_per_replica`` steps is a 32x32 bit matrix, squared for each bit of the replica."""
    # columns[b] is the image of bit b
    step = xorshift_step(np.uint32(1) << np.arange(32, dtype=np.uint32))
    jump = _matrix_power(step, outputs_per_replica)
    states = np.full(len(replicas), seed & _MASK, dtype=np.uint32)
    remaining = replicas.astype(np.uint64)
    while remaining.any():
        odd = (remaining & np.uint64(1)).astype(bool)
        states[odd] = _apply(jump, states[odd])
        jump = _apply(jump, jump)
        remaining = remaining >> np.uint64(1)
    return states


def _apply(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for bit in range(32):
        out ^= np.where((states >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _matrix_power(columns: np.ndarray, exponent: int) -> np.ndarray:
    result = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while exponent:
        if exponent & 1:
            result = _apply(columns, result)
        columns = _apply(columns, columns)
        exponent >>= 1
    return result
