"""Reproducible randomness: a row's draw depends on its key and a seed, never on partitioning."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0  # 2^32: eight hex digits of an md5


def key_hash(*keys: Column | str, seed: int | Column = 42) -> Column:
    """Integer in [0, 2^32) from the keys and the seed."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    tail = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *parts, tail)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit_hash(*keys: Column | str, seed: int | Column = 42) -> Column:
    """Number in [0, 1) from the keys and the seed."""
    return key_hash(*keys, seed=seed) / F.lit(SPAN)


#: A Poisson(1) count exceeds 13 with probability 6e-12, less than the step of a 32-bit draw: no draw is cut.
POISSON_TOP = 13


def poisson1(u: Column, top: int = POISSON_TOP) -> Column:
    """Poisson(1) count by inverting a uniform draw (bootstrap weights)."""
    out, cdf, p = F.lit(0), 0.0, 2.718281828459045 ** -1
    for k in range(top):
        cdf += p
        out = out + F.when(u >= F.lit(cdf), 1).otherwise(0)
        p /= k + 1
    return out


def key_prefix(*keys: Column | str) -> Column:
    """The part of the hashed text that the keys make, to be built once for many draws; null where all keys are null."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("|", *parts))


def digest(prefix: Column, draw: Column, seed: int = 42) -> Column:
    """The md5 whose first eight digits ``key_hash`` reads, from ``key_prefix`` and the number of the draw."""
    return F.md5(F.concat_ws("|", prefix, draw.cast("string"), F.lit(str(seed))).cast("binary"))


def poisson1_edges(top: int = POISSON_TOP) -> list[int]:
    """The least first eight digits, as numbers, of the counts 1, 2, ... of ``poisson1``."""
    cdf, p, edges = 0.0, 2.718281828459045 ** -1, []
    for k in range(top):
        cdf += p
        least = math.ceil(cdf * SPAN)
        if least < SPAN:
            edges.append(least)
        p /= k + 1
    return edges


def poisson1_of(md5: Column, top: int = POISSON_TOP) -> Column:
    """``poisson1`` of the digest's ``unit_hash``: equal digits compare as numbers do, so no number is read from them."""
    steps = [(k, f"{least:08x}") for k, least in enumerate(poisson1_edges(top))]
    out = F.when(md5 < steps[0][1], 0)
    for k, edge in steps[1:]:
        out = out.when(md5 < edge, k)
    return out.otherwise(len(steps))


def standard_normal(*keys: Column | str, seed: int = 42) -> Column:
    """Normal draw from two uniform draws (Box-Muller)."""
    u = F.greatest(unit_hash(*keys, seed=seed), F.lit(1e-12))
    v = unit_hash(*keys, seed=seed + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
