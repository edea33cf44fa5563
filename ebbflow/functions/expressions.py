"""Pure column builders: no shuffle, no Python worker, the same on batch and streaming frames."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use).getItem(0)


def vector(names: Sequence[str | Column]) -> Column:
    """The named columns as ``array<double>``."""
    return F.array(*[(F.col(n) if isinstance(n, str) else n).cast("double") for n in names])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def entropy(counts: Column) -> Column:
    """Bits of an array of counts; 0 if they sum to 0."""
    whole = total(F.transform(counts, lambda c: c.cast("double")))
    return bind(whole, lambda n: F.when(n > 0, total(F.transform(counts, lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)))).otherwise(0.0))


def gini(counts: Column) -> Column:
    """Gini impurity of an array of counts; 0 if they sum to 0."""
    whole = total(F.transform(counts, lambda c: c.cast("double")))
    return bind(whole, lambda n: F.when(n > 0, 1.0 - total(F.transform(counts, lambda c: (c / n) * (c / n)))).otherwise(0.0))


def hoeffding_bound(span: Column | float, delta: float, n: Column) -> Column:
    """``sqrt(span^2 ln(1/delta) / 2n)``."""
    span = F.lit(span) if isinstance(span, int | float) else span
    return F.sqrt(span * span * F.lit(math.log(1 / delta)) / (2 * n))


def distance(kind: str, a: Column, b: Column, p: float = 2.0) -> Column:
    """``euclidean, cityblock, chebyshev, minkowski`` or ``cosine`` distance of two arrays of equal length."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if kind == "euclidean":
        return F.sqrt(total(F.transform(gaps, lambda g: g * g)))
    if kind == "cityblock":
        return total(gaps)
    if kind == "chebyshev":
        return F.array_max(gaps)
    if kind == "minkowski":
        return F.pow(total(F.transform(gaps, lambda g: F.pow(g, F.lit(p)))), F.lit(1 / p))
    if kind == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    raise ValueError(f"unknown distance {kind}")


def ks_statistic(first: Column, second: Column) -> Column:
    """Largest gap of the two empirical distribution functions; 0 if either sample is empty.

    The pooled values are sorted once and walked with a running difference,
    which is read only where the next value differs.
    """
    a, b = F.size(first), F.size(second)
    marked = F.concat(
        F.transform(first, lambda v: F.struct(v.cast("double").alias("v"), (F.lit(1.0) / a).alias("w"))),
        F.transform(second, lambda v: F.struct(v.cast("double").alias("v"), (F.lit(-1.0) / b).alias("w"))),
    )

    def walk(pooled):
        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("m"), F.lit(0).alias("i"))

        def step(s, x):
            moved = s["d"] + x["w"]
            last = F.coalesce(F.get(pooled, s["i"] + 1)["v"] != x["v"], F.lit(True))
            return F.struct(moved.alias("d"), F.when(last, F.greatest(s["m"], F.abs(moved))).otherwise(s["m"]).alias("m"), (s["i"] + 1).alias("i"))

        return F.aggregate(pooled, start, step, lambda s: s["m"])

    return F.when((a > 0) & (b > 0), bind(F.array_sort(marked), walk)).otherwise(0.0)


def ks_critical(n1: int, n2: int, alpha: float) -> float:
    """Asymptotic critical value of the two-sample test."""
    return math.sqrt(-0.5 * math.log(alpha / 2)) * math.sqrt((n1 + n2) / (n1 * n2))


def argmax_label(weights: Column) -> Column:
    """Key of the greatest value of a ``map``; the least key of several, null if empty."""
    entries = F.map_entries(weights)
    best = F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return best["k"]


def uniform(seed: int, *parts: Column | int) -> Column:
    """Uniform in [0, 1), a pure function of seed and parts: the same whatever the partitioning."""
    values = [F.lit(p) if isinstance(p, int) else p for p in parts]
    mixed = F.xxhash64(F.lit(seed).cast("long"), *[v.cast("long") for v in values])
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *parts: Column | int) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, *parts, 0)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, *parts, 1))


def poisson(rate: float, seed: int, *parts: Column | int) -> Column:
    """Poisson counts by inverse distribution function on one uniform; exact to the last representable tail."""
    u = uniform(seed, *parts)
    bounds, p, below, k = [], math.exp(-rate), 0.0, 0
    while True:
        below += p
        bounds.append(below)
        k += 1
        p *= rate / k
        if k > rate and below + p == below:
            break
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= u))
