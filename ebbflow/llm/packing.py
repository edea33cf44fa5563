"""Sequence packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of the maximal length as fit and
then one piece for each set bit of the rest, longest first. Every piece is a
sequence of its own, so no sequence crosses documents, none is padded, and the
sequences of one length form a bucket from which batches of one shape are
drawn. The cut depends on the document alone: there is no shuffle, and a lost
task is run again for the same result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import arrow_map, slices, string_values, worker_encoder


def decompose(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, each a power of two up to ``max_length``."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, max_length: int = 2048, drops_space: bool = False, digest: bool = False, cache: int = 600_000
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id, start, length, doc_tokens, bucket, sequence_id, offset`` and their ids.

    ``ids`` holds the piece's ids (``array<int>``); with ``digest`` their CRC-32
    takes its place (``ids_crc32``: little-endian unsigned 32-bit integers).
    ``bucket`` is the logarithm of the length. A null or empty text is the end
    id alone. Null and repeated document ids are kept as they are, each row
    packed by itself; a worker remembers the ids of at most ``cache`` words; other columns are ignored; an empty table gives no rows.
    """
    decompose(0, max_length)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encoder = worker_encoder(tokenizer_path, drops_space, cache)
        for batch in slices(batches):
            rows, starts, lengths, totals, crcs, values = [], [], [], [], [], []
            for k, text in enumerate(string_values(batch.column(1))):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                pieces, view, at = decompose(n, max_length), memoryview(ids), 0
                for length in pieces:
                    starts.append(at)
                    if digest:
                        crcs.append(zlib.crc32(view[4 * at : 4 * (at + length)]))
                    at += length
                rows += [k] * len(pieces)
                totals += [n] * len(pieces)
                lengths += pieces
                if not digest:
                    values.append(ids)
            size = np.array(lengths, dtype=np.int64)
            out = [
                batch.column(0).take(pa.array(rows, pa.int32())),
                pa.array(starts, pa.int64()),
                pa.array(size),
                pa.array(totals, pa.int64()),
                pa.array(np.log2(np.maximum(size, 1)).astype(np.int32)),
            ]
            if digest:
                out.append(pa.array(crcs, pa.int64()))
            else:
                bounds = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                out.append(pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(values), dtype="<i4"))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "doc_tokens", "bucket", "ids_crc32" if digest else "ids"])

    last = "ids_crc32 long" if digest else "ids array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = arrow_map(texts, cut, f"doc_id long, start long, length long, doc_tokens long, bucket int, {last}", encodes=True)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each sequence length, so a loader draws batches of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)
