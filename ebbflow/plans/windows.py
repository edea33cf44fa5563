"""Prefix aggregates and bounded windows that don't put all rows of a key into one task.

``Window.partitionBy(key)`` gives one key to one task. Here the rows of a key
are first dealt into blocks along their order, by fixed bounds on the first
order column, so a key with a third of all rows is spread like any other.
Mergeable states are aggregated once for each block and the sums of the blocks
before are joined back; bounded windows take the last rows of the block before
along as a halo.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbflow.plans.layout import Names, names

#: Least and most blocks of an order. They balance work and don't change results; a table of sizes beyond has larger blocks.
BLOCKS, MOST_BLOCKS = 32, 2048


def _columns(of: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{c}`") for c in of]


@dataclass(frozen=True)
class Blocks:
    """Bounds on the first order column, in its numeric form. They only balance the work: any bounds give the same results."""

    first: str
    kind: str
    bounds: tuple[float, ...]

    @staticmethod
    def _number(first: str, kind: str) -> Column:
        column = F.col(f"`{first}`")
        return F.unix_micros(column.cast("timestamp")).cast("double") if kind.startswith("timestamp") or kind == "date" else column.cast("double")

    def number(self) -> Column:
        """Number of a row's block: how many bounds lie below it."""
        if not self.bounds:
            return F.lit(0)
        value = self._number(self.first, self.kind)

        def place(low: int, high: int) -> Column:
            """How many of the bounds lie below, where it is known to be from ``low`` to ``high``."""
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(value > self.bounds[middle], place(middle + 1, high)).otherwise(place(low, middle))

        # plain comparisons by halves: compiled, and safe to infer filters from (a lambda would hide its column from the optimizer)
        return F.when(value.isNull(), 0).otherwise(place(0, len(self.bounds)))


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "date")


def order_blocks(df: DataFrame, order_by: Names, blocks: int | None = None) -> Blocks:
    """Quantiles of the whole table (one pass, ``blocks`` numbers for the driver). Columns without a numeric form make one block.

    By default there are twice as many blocks as shuffle partitions.

    Results that are built in several steps on one table take its blocks once
    and hand them on.
    """
    blocks = blocks or min(MOST_BLOCKS, max(BLOCKS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = names(order_by)[0]
    kind = dict(df.dtypes)[first]
    if kind not in _NUMERIC and not kind.startswith(("timestamp", "decimal")):
        return Blocks(first, kind, ())
    shares = [k / blocks for k in range(1, blocks)]
    bounds = df.agg(F.percentile_approx(Blocks._number(first, kind), shares, max(1000, 20 * blocks)).alias("b")).first()["b"] or []
    return Blocks(first, kind, tuple(sorted(set(bounds))))


def prefix(df: DataFrame, sums: Mapping[str, tuple[str, Column]], order_by: Names, key: Names = None, inclusive: bool = True, blocks: Blocks | None = None) -> DataFrame:
    """``df`` with running aggregates of each row's key, over the rows up to it or, if not ``inclusive``, before it.

    ``sums`` maps a new column to (``sum``, ``count``, ``min`` or ``max``, and
    the column). Nulls are skipped; ``sum``, ``min`` and ``max`` over no values
    are null, ``count`` is 0. Ties of ``order_by`` are given places in an
    unspecified way, so it should be a total order. Null keys are one key.
    """
    order, keys = names(order_by), names(key)
    block = (blocks or order_blocks(df, order)).number()
    rows = df.select(F.struct("*").alias("__row"), block.alias("__block"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(order)], *[v.alias(f"__v{i}") for i, (_, v) in enumerate(sums.values())])
    by = [f"__k{i}" for i in range(len(keys))]
    kinds = [kind for kind, _ in sums.values()]
    whole = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    joins = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    of_blocks = rows.groupBy(*by, "__block").agg(*[whole[kind](f"__v{i}").alias(f"__p{i}") for i, kind in enumerate(kinds)])
    # one row for each key and block
    above = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = of_blocks.select(
        *[F.col(k).alias(f"{k}_b") for k in by], F.col("__block").alias("__block_b"), *[joins[kind](f"__p{i}").over(above).alias(f"__c{i}") for i, kind in enumerate(kinds)]
    )
    frame = Window.partitionBy(*by, "__block").orderBy(*[f"__o{i}" for i in range(len(order))])
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = rows.select("*", *[whole[kind](f"__v{i}").over(frame).alias(f"__w{i}") for i, kind in enumerate(kinds)])
    on = F.col("__block") == F.col("__block_b")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    met = inner.join(before, on)

    def merged(i: int, kind: str) -> Column:
        own, other = F.col(f"__w{i}"), F.col(f"__c{i}")
        if kind == "count":
            return own + F.coalesce(other, F.lit(0).cast("long"))
        if kind == "sum":
            return F.when(own.isNull(), other).when(other.isNull(), own).otherwise(own + other)
        return F.least(own, other) if kind == "min" else F.greatest(own, other)

    return met.select("__row.*", *[merged(i, kind).alias(name) for i, (name, kind) in enumerate(zip(sums, kinds, strict=True))])


def row_numbers(df: DataFrame, order_by: Names, key: Names = None, name: str = "rn", blocks: Blocks | None = None) -> DataFrame:
    """``df`` with the place of each row in its key, from 1, without sorting a key in one task."""
    return prefix(df, {name: ("count", F.lit(1))}, order_by, key, blocks=blocks)


def halo_blocks(df: DataFrame, order_by: Names, width: int, key: Names = None, rows_per_block: int = 20_000, blocks: Blocks | None = None) -> DataFrame:
    """Rows with ``__rn``, ``__part`` and ``__halo``: parts of at most ``rows_per_block + width - 1`` rows that hold all windows of ``width``.

    A row is also given, with ``__halo`` true, to the next part if one of that
    part's windows may reach back to it.
    """
    reach = width - 1
    size = max(rows_per_block, reach, 1)
    numbered = row_numbers(df, order_by, key, "__rn", blocks)
    at = F.col("__rn") - 1
    own = F.floor(at / size)
    also = F.when(at % size >= size - reach, F.array(F.struct(own.alias("p"), F.lit(False).alias("h")), F.struct((own + 1).alias("p"), F.lit(True).alias("h"))))
    dealt = numbered.withColumn("__to", F.explode(F.coalesce(also, F.array(F.struct(own.alias("p"), F.lit(False).alias("h"))))))
    return dealt.select(*[F.col(f"`{c}`") for c in numbered.columns], F.col("__to.p").alias("__part"), F.col("__to.h").alias("__halo"))


def sliding(df: DataFrame, values: Mapping[str, Column], width: int, order_by: Names, key: Names = None, rows_per_block: int = 20_000) -> DataFrame:
    """``df`` with aggregates over the last ``width`` rows of each row's key, the row included.

    ``values`` maps a new column to an aggregate expression.
    """
    order, keys = names(order_by), names(key)
    dealt = halo_blocks(df, order, width, keys, rows_per_block)
    frame = Window.partitionBy(*_columns(keys), "__part").orderBy("__rn").rowsBetween(-(width - 1), 0)
    out = dealt.select("*", *[v.over(frame).alias(n) for n, v in values.items()]).where(~F.col("__halo"))
    return out.drop("__rn", "__part", "__halo")
