"""Seeded draws as pure functions of (seed, draw index).

The generator's state is a counter, so draw ``n`` needs no earlier draw and the
result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit mulberry generator.
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit values modulo 2 ** 32, in halves so that 64 bits suffice."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + a.bitwiseAND(0xFFFF) * b).bitwiseAND(F.lit(MASK).cast("long"))


def draw(seed: int | Column, n: Column) -> Column:
    """Uniform draw number ``n`` (from 1) in [0, 1) of the generator seeded with ``seed``."""
    mask = F.lit(MASK).cast("long")
    s = seed.cast("long") if isinstance(seed, Column) else F.lit(seed & MASK).cast("long")
    x = (s.bitwiseAND(mask) + _times(n.cast("long").bitwiseAND(mask), F.lit(STEP).cast("long"))).bitwiseAND(mask)
    t = _times(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / F.lit(4294967296.0)


def draw_value(seed: int, n: int) -> float:
    """The same draw in plain Python."""
    x = (seed + n * STEP) & MASK
    t = ((x ^ x >> 15) * (x | 1)) & MASK
    t ^= (t + ((t ^ t >> 7) * (t | 61))) & MASK
    return ((t ^ t >> 14) & MASK) / 4294967296


def generator(seed: int, used: int = 0) -> Callable[[], float]:
    """Draws one after the other, from the one after ``used``; ``generator.used`` counts on."""
    def following() -> float:
        following.used += 1
        return draw_value(seed, following.used)

    following.used = used
    return following


def permutation(n: int, following: Callable[[], float]) -> list[int]:
    """The order in which a Fisher-Yates shuffle leaves 0 .. n - 1; it takes n - 1 draws."""
    order = list(range(n))
    for last in range(n - 1, 0, -1):
        other = int(following() * (last + 1))
        order[last], order[other] = order[other], order[last]
    return order
