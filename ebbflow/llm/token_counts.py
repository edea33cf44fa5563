"""Exact histogram of encoded lengths, and what its suffix sums answer.

Executors encode whole texts and emit counts by length for each few hundred
documents; those are summed by key, so a shuffle carries one row for each
length and task and never the documents. The histogram holds at most one row
for each distinct length. Suffix sums are built in two levels (within a bucket
of lengths, and over buckets) so that no task sorts the whole histogram.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbflow.llm.shared import arrow_map, slices, stored, string_values, worker_encoder

BUCKET = 256


def length_histogram(docs: DataFrame, tokenizer_path: str, by: str = "lang", drops_space: bool = False) -> DataFrame:
    """``group, n_tokens, n_docs``: documents of each encoded length in each value of ``by``.

    Null and empty texts have length 0; null groups count together; repeated
    rows all count; an empty table gives no rows; other columns are ignored.
    """

    def count(batches):
        encoder = worker_encoder(tokenizer_path, drops_space)
        for batch in slices(batches, 4096):
            found = Counter(
                (group, len(encoder.encode(text)) // 4)
                for group, text in zip(batch.column(0).to_pylist(), string_values(batch.column(1)), strict=True)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in found], pa.string()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["group", "n_tokens", "n_docs"],
            )

    rows = docs.select(F.col(by).cast("string").alias("group"), F.col("text").cast("string").alias("text"))
    counted = arrow_map(rows, count, "group string, n_tokens long, n_docs long", encodes=True)
    return counted.groupBy("group", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length L of a group:

    ``tokens`` (of documents of that length), ``docs_at_least`` and
    ``tokens_at_least`` (of documents of L ids or more), ``group_docs``,
    ``group_tokens`` and ``truncated_tokens`` (ids left if every document is cut
    at L).
    """
    # read twice below, and making it encodes all texts
    cells = stored(histogram.select("group", "n_tokens", "n_docs")).withColumns(
        {"tokens": F.col("n_tokens") * F.col("n_docs"), "cell": F.floor(F.col("n_tokens") / BUCKET)}
    )
    whole = Window.partitionBy("group")
    above = whole.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        cells.groupBy("group", "cell")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            F.col("group").alias("of"),
            F.col("cell").alias("at"),
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(whole).alias("group_docs"),
            F.sum("t").over(whole).alias("group_tokens"),
        )
    )
    inner = Window.partitionBy("group", "cell").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = cells.withColumns({"d_in": F.sum("n_docs").over(inner), "t_in": F.sum("tokens").over(inner)}).join(
        buckets, F.col("group").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))
    )
    out = joined.select(
        "group", "n_tokens", "n_docs", "tokens",
        (F.col("d_in") + F.col("docs_above")).alias("docs_at_least"),
        (F.col("t_in") + F.col("tokens_above")).alias("tokens_at_least"),
        "group_docs", "group_tokens",
    )
    return out.withColumn(
        "truncated_tokens", F.col("group_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``group, context, total``: ids left when every document is cut at each of ``limits``. One row for each group and limit."""
    grid = sums.select("*", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context"))
    return grid.groupBy("group", "context").agg(
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("total")
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``group, share, n_tokens``: the least length that at least ``share`` of a group's documents don't exceed."""
    grid = sums.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    reached = F.col("group_docs") - F.col("docs_at_least") + F.col("n_docs") >= F.col("share") * F.col("group_docs")
    return grid.where(reached).groupBy("group", "share").agg(F.min("n_tokens").alias("n_tokens"))
