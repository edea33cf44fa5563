"""Token ids in ORC: stripes of run-length encoded integers, row indexes, Bloom filters on document ids.

``write_token_files`` range-partitions the *texts* by document id (texts are
smaller than their ids), sorts each range, encodes it once and writes one ORC
file for each range. A row holds the document id, the number of ids before it
in its file, and the ids. ``file_offsets`` reads only two integer columns to
learn where each file starts in the whole corpus; their number is the number of
files, so the driver may hold them. Everything else stays on the executors, and
a lost task is simply run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.shared import arrow_map, shuffle_width, slices, string_values, worker_encoder

FILE_SCHEMA = "part int, doc_id long, part_start long, n_tokens int, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
}


def _encoder(tokenizer_path: str, end_id: int, drops_space: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        encoder = worker_encoder(tokenizer_path, drops_space)
        part = TaskContext.get().partitionId()
        before = 0
        for batch in slices(batches):
            chunks = [encoder.encode(text) + end for text in string_values(batch.column(1))]
            lengths = np.array([len(chunk) // 4 for chunk in chunks], dtype=np.int64)
            ends = np.cumsum(lengths)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(chunks), dtype="<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(chunks), part, dtype=np.int32)),
                    batch.column(0),
                    pa.array(before + ends - lengths),
                    pa.array(lengths.astype(np.int32)),
                    ids,
                ],
                ["part", "doc_id", "part_start", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    return encode


#: Texts of one file, as Spark estimates the table's size; a task holds one file's sort.
FILE_BYTES = 128 << 20


def file_count(docs: DataFrame) -> int:
    """At least one file for each shuffle partition, and more where the table's estimated size calls for them."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    known = size < 1 << 60  # Spark's stand-in for tables of unknown size is 2**63 - 1
    return max(shuffle_width(docs.sparkSession), -(-size // FILE_BYTES) if known else 1)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, drops_space: bool, files: int | None = None
) -> None:
    """Encode ``docs(doc_id, text)`` and write ``path`` in ascending ``doc_id`` order.

    Null texts count as empty and so hold the end id alone. Null ids sort
    first; equal ids are all kept, ordered by a hash of their text. Other
    columns are ignored. An empty table writes no documents. Without ``files``
    their number follows the table's size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(files or file_count(rows), *order).sortWithinPartitions(*order)
    encoded = arrow_map(ranged, _encoder(tokenizer_path, end_id, drops_space), FILE_SCHEMA, encodes=True)
    encoded.write.mode("errorifexists").options(**ORC_OPTIONS).orc(path)


def file_offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids in all files before each file. One entry for each file."""
    totals = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()
    offsets, before = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = before
        before += row["total"]
    return offsets


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files: ``part``, ``doc_id``, ``part_start``, ``n_tokens``, ``ids``; stripes are read in parallel."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id. The predicate reaches the reader, which skips stripes and row groups by index and Bloom filter."""
    return read_token_files(spark, path).where(F.col("doc_id").isin([int(d) for d in doc_ids]))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts the ids of all documents before it."""
    offsets = file_offsets(spark, path)

    def digest(batches):
        for batch in slices(batches, 2048):
            parts, starts, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(4)
            values, bounds = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B"), ids.offsets.to_numpy() * 4
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            base = np.array([offsets[p] for p in parts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(base + starts), batch.column(3).cast(pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return arrow_map(read_token_files(spark, path), digest, "doc_id long, start long, n_tokens long, ids_crc32 long", encodes=True)
