"""Ordered tables as streams: batches, the first rows, all but the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.expressions import vector
from ebbflow.plans.layout import Layout, Names, names
from ebbflow.plans.windows import row_numbers


def from_columns(spark: SparkSession, x: Sequence[Sequence[float]], y: Sequence | None = None) -> DataFrame:
    """``seq, x[, y]`` from rows of features and targets in the driver; no rows give an empty frame."""
    kind = "double" if y and isinstance(y[0], float) else "int"
    schema = "seq long, x array<double>" + (f", y {kind}" if y is not None else "")
    if y is not None and len(x) != len(y):
        raise ValueError("x and y differ in length")
    rows = [(i, [float(v) for v in row], *([y[i - 1]] if y is not None else [])) for i, row in enumerate(x, 1)]
    return spark.createDataFrame(rows, schema)


def from_table(df: DataFrame, target: str, features: Names = None, order_by: Names = None) -> DataFrame:
    """Order columns, ``x`` (the features as doubles; by default all columns but target and order) and ``y``."""
    if not isinstance(df, DataFrame):
        raise TypeError("not a table")
    at = Layout.of(df, features, target, order_by, None, ordered=False)
    return df.select(*[F.col(f"`{o}`") for o in at.order_by], vector([F.col(f"`{f}`") for f in at.features]).alias("x"), F.col(f"`{target}`").alias("y"))


def batch_stream(df: DataFrame, size: int, order_by: Names, key: Names = None, name: str = "batch_id") -> DataFrame:
    """``df`` with the number of each row's batch of at most ``size`` rows, from 0; the last may be smaller."""
    if size <= 0:
        raise ValueError("size must be positive")
    return row_numbers(df, order_by, key, "__rn").withColumn(name, F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def batches(df: DataFrame, size: int, order_by: Names, features: Names, target: str) -> DataFrame:
    """One row for each batch: ``batch_id``, ``x`` (rows in order) and ``y``. A batch is ``size`` rows, so a group is bounded."""
    at = Layout.of(df, features, target, order_by)
    numbered = row_numbers(df, at.order_by, None, "__rn").withColumn("batch_id", F.floor((F.col("__rn") - 1) / size))
    entry = F.struct(F.col("__rn"), vector([F.col(f"`{f}`") for f in at.features]).alias("x"), F.col(f"`{target}`").alias("y"))
    grouped = numbered.groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("__rows"))
    return grouped.select("batch_id", F.transform("__rows", lambda r: r["x"]).alias("x"), F.transform("__rows", lambda r: r["y"]).alias("y"))


def take_stream(df: DataFrame, n: int, order_by: Names, key: Names = None) -> DataFrame:
    """The first ``n`` rows, of each key if there is one."""
    if not names(key):
        return df.orderBy(*[F.col(f"`{o}`") for o in names(order_by)]).limit(n)
    return row_numbers(df, order_by, key, "__rn").where(F.col("__rn") <= n).drop("__rn")


def skip_stream(df: DataFrame, n: int, order_by: Names, key: Names = None) -> DataFrame:
    """All but the first ``n`` rows, of each key if there is one."""
    return row_numbers(df, order_by, key, "__rn").where(F.col("__rn") > n).drop("__rn")
