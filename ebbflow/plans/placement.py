"""Where few large keys go, and one number to sort their rows by.

Dealt by hash, two large keys may meet in one task, which then takes twice as
long. If keys are few they are counted first and each is given its partition,
the largest first. The same pass finds the ranges of the order columns, so the
key and as much of its order as fits are packed in one long: comparing two rows
then seldom has to look at the rows themselves.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many keys are placed one by one; more are dealt by hash.
PLACED_KEYS = 256
#: So many order columns are packed at most; two rows seldom agree in them.
PACKED = 2


@dataclass(frozen=True)
class Placement:
    """``place``: a row's partition. ``prefix``: never falls in the order of key (by size), ``kind`` and order columns."""

    partitions: int
    place: Column
    prefix: Column


def _number(name: str, kind: T.DataType) -> Column | None:
    """A long that never falls in the order of a column, whatever the time zone; None where its type has none. All are exact but the day of a time without zone."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.col(name).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.col(name).cast("date")).cast("long")
    return None


def measure(df: DataFrame, keys: list[str], orders: list[str], partitions: int, others: bool = False) -> Placement | None:
    """One aggregation of ``df``. None if keys are more than ``PLACED_KEYS``. With ``others``, rows of keys that ``df`` has not will be placed too."""
    numbers: list[Column] = []
    exact: list[Column] = []
    for o in orders[:PACKED]:
        kind = df.schema[o].dataType
        number = _number(o, kind)
        if number is None:
            break
        numbers.append(number)
        exact.append(F.col(o).cast("date").cast(kind) == F.col(o) if isinstance(kind, T.TimestampNTZType) else F.lit(True))
    mark = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])
    ranges = [f(v).alias(f"{name}{i}") for i, v in enumerate(numbers) for name, f in (("lo", F.min), ("hi", F.max))]
    ranges += [F.min(v).alias(f"exact{i}") for i, v in enumerate(exact)]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ranges).limit(PLACED_KEYS + 1)
    found = sorted(counted.select("*", mark.alias("mark")).collect(), key=lambda r: (-r["n"], r["mark"]))
    if not found or len(found) > PLACED_KEYS or len({r["mark"] for r in found}) < len(found):
        return None

    if not others:
        partitions = min(partitions, len(found))
    loads = [(0, p) for p in range(partitions)]
    places = []
    for r in found:
        load, p = heapq.heappop(loads)
        places.append(p)
        heapq.heappush(loads, (load + r["n"], p))
    rank = F.array_position(F.array(*[F.lit(r["mark"]) for r in found]), mark).cast("int")
    place = F.when(rank > 0, F.element_at(F.array(*[F.lit(p) for p in places]), rank)).otherwise(F.pmod(F.hash(*keys), F.lit(partitions)))

    free = 63 - len(found).bit_length()
    packed = rank.cast("long")
    for i, number in enumerate(numbers):
        seen = [(r[f"lo{i}"], r[f"hi{i}"]) for r in found if r[f"lo{i}"] is not None]
        lo, hi = (min(v[0] for v in seen), max(v[1] for v in seen)) if seen else (0, 0)
        bits = (hi - lo + 1).bit_length()
        if not seen or bits > 62:
            break
        value = F.when(number.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), number)) - F.lit(lo) + 1).cast("long")
        used = min(bits, free)
        packed = F.shiftleft(packed, used) + F.shiftright(value, bits - used)
        free -= used
        if used < bits or not all(r[f"exact{i}"] is not False for r in found):
            break
    return Placement(partitions, place, F.when(rank > 0, F.shiftleft(packed, free)).otherwise(F.lit(0)).cast("long"))
