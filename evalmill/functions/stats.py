"""Interval, test and power statistics as Column expressions.

Every function takes Columns and returns a Column that is null where the figure
is undefined, so that each can stand in any aggregation or projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054
Z_POWER_80 = 0.8416212335729143
#: Terms that the tail of McNemar's test has at most where it is summed from its first.
FEW_TERMS = 1000
#: A percentile of fewer values is marked as of low confidence.
PERCENTILE_GATES = (("p50_ms", 5), ("p90_ms", 10), ("p95_ms", 20), ("p99_ms", 100))


def z_for_alpha(alpha: float) -> float:
    """The two-sided normal quantile; 0.05 has its pinned value."""
    return Z_95 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)


def z_for_power(power: float) -> float:
    return Z_POWER_80 if power == 0.8 else NormalDist().inv_cdf(power)


def _double(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def wilson_interval(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """The Wilson score interval (low, high), clamped to [0, 1]; null for no trials."""
    n, p = _double(n), F.try_divide(_double(successes), _double(n))
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    margin = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    there = n > 0
    low, high = F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)
    return F.when(there, low), F.when(there, high)


def low_confidence_percentiles(n: Column) -> Column:
    """The names of the percentiles that so few values don't support, in ascending order."""
    names = F.array(*(F.when(n < gate, F.lit(name)) for name, gate in PERCENTILE_GATES))
    return F.filter(names, lambda name: name.isNotNull())


def phi_coefficient(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The correlation of two paired outcomes; 0 where a margin is empty."""
    a, b, c, d = map(_double, (a, b, c, d))
    product = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(product > 0, (a * d - b * c) / F.sqrt(product)).otherwise(F.lit(0.0))


def newcombe_interval(a: Column, b: Column, c: Column, d: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Newcombe's tenth method for a paired difference, as candidate minus baseline.

    The table counts a both, b baseline only, c candidate only, d neither.
    """
    a, b, c, d = map(_double, (a, b, c, d))
    n = a + b + c + d
    p1, p2, phi = F.try_divide(a + b, n), F.try_divide(a + c, n), phi_coefficient(a, b, c, d)
    (l1, u1), (l2, u2) = wilson_interval(a + b, n, z), wilson_interval(a + c, n, z)

    def reach(x: Column, y: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), x * x - 2 * phi * x * y + y * y))

    low, high = reach(p1 - l1, u2 - p2), reach(u1 - p1, p2 - l2)
    return -((p1 - p2) + high), -((p1 - p2) - low)


def _summed(steps: Column, first: Column, ratio: Callable[[Column], Column]) -> Column:
    """first + first * r1 + first * r1 * r2 + ..., of logarithms of the terms."""
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log(ratio(_double(k)))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def mcnemar_exact(b: Column, c: Column) -> Column:
    """The exact two-sided p-value of discordant pairs, folded in log space; 1 for none.

    Up to ``FEW_TERMS`` terms are summed from C(n, 0) on, each from the last by
    one division. Beyond, the sum starts at its largest term, taken from
    Stirling's series, and runs down for seven square roots of n: what is left
    out is under one part in 1e30, and the work grows with that root only.
    """
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    nd, k = _double(n), _double(low)
    none, one = F.array().cast("array<bigint>"), F.lit(1).cast("long")
    few = F.when((low > 0) & (low <= FEW_TERMS), F.sequence(one, low)).otherwise(none)
    short = _summed(few, -nd * math.log(2), lambda i: (nd - i + 1) / i)

    x, rest = (nd - 2 * k) / nd, nd - k
    bulk = -nd / 2 * ((1 - x) * F.log1p(-x) + (1 + x) * F.log1p(x))
    series = (1 / nd - 1 / k - 1 / rest) / 12 - (F.pow(nd, -3) - F.pow(k, -3) - F.pow(rest, -3)) / 360
    largest = bulk + F.log(nd / (2 * math.pi * k * rest)) / 2 + series
    down = F.sequence(low, F.greatest(one, low - F.ceil(7 * F.sqrt(nd))), F.lit(-1).cast("long"))
    long = _summed(F.when(low > FEW_TERMS, down).otherwise(none), largest, lambda i: i / (nd - i + 1))
    tail = F.when(low > FEW_TERMS, long).otherwise(short)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def _needed(delta: Column, p1: Column, z_alpha: float, z_power: float) -> Column:
    p2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p1 - delta))
    mean = (p1 + p2) / 2
    spread = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_power * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.pow(spread / delta, 2)


def required_n(delta: Column, p1: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Cases per run that show a fall of ``delta`` from ``p1``; null outside 0 < delta <= p1 < = 1."""
    delta, p1 = _double(delta), _double(p1)
    there = (delta > 0) & (delta < 1) & (delta <= p1) & (p1 <= 1)
    return F.when(there, F.ceil(_needed(delta, p1, z_for_alpha(alpha), z_for_power(power))))


def minimum_detectable_difference(n: Column, p1: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The smallest fall that ``n`` cases show, by twenty halvings, at most ``p1``."""
    n, p1 = _double(n), _double(p1)
    z = z_for_alpha(alpha), z_for_power(power)

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        enough = _needed(middle, p1, *z) <= n
        return F.struct(
            F.when(enough, acc["low"]).otherwise(middle).alias("low"),
            F.when(enough, middle).otherwise(acc["high"]).alias("high"),
        )

    start = F.struct(F.lit(1e-6).alias("low"), F.lit(1 - 1e-6).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, halve, lambda acc: acc["high"])
    return F.when(n > 0, F.least(found, p1))


def intervals_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals share a point; null where either is unknown."""
    return (low_a <= high_b) & (low_b <= high_a)


def is_close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where lengths differ, a vector is empty, or its norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms)


def normalized_rating(raw: Column, low: Column | float, high: Column | float) -> Column:
    """A rating's place on its scale, from 0 to 1."""
    return clip((raw - low) / (_double(high) - _double(low)))
