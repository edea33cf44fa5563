"""Operators on unbounded input.

Mergeable operators are ordinary streaming aggregations. Sequential operators
keep one state for each key in the state store (RocksDB), where the states of a
bucket of keys are one row, and use the same step code as the batch fold; within
a micro-batch the rows of a key are sorted by the order columns before they are
learned. Rows that come in a later micro-batch count as later, whatever their
order columns say; a source or a watermark must take care of what is late.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbflow.functions.expressions import vector
from ebbflow.plans.fold import Fold, struct_of
from ebbflow.plans.layout import Layout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """States on local disk, so they need not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Keys are dealt into so many groups, which checkpoints depend on.
BUCKETS = 4096


class _Processor:
    """Learns the rows of a bucket of keys. States are stored as JSON, whose numbers are exact; only those of keys with new rows are read.

    A call for each key would cost more than what is learned in it, and a round
    trip to the store for each key more still: here states travel with the rows
    in Arrow batches, and what a group costs does not grow with the keys.
    """

    def __init__(self, op: Fold, orders: list[str], d: int, columns: list[str], names: list[str], outputs: list[str]):
        self.op, self.orders, self.d, self.columns, self.names, self.outputs = op, orders, d, columns, names, outputs

    def __call__(self, bucket: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(chunks), ignore_index=True)
        frame.columns = self.columns
        if self.orders:
            frame = frame.sort_values(self.orders, kind="stable", na_position="first", ignore_index=True)
        codes, keys = pd.factorize(frame["__key"])
        frame = frame.take(np.argsort(codes, kind="stable")).reset_index(drop=True)
        x = np.array([[np.nan if v is None else v for v in row] for row in frame["__x"]], dtype=np.float64).reshape(-1, self.d)
        y = frame["__y"].to_numpy(dtype=np.float64, na_value=np.nan)
        valid = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
        states = json.loads(held.get[0]) if held.exists else {}
        values: dict[str, list[Any]] = {name: [None] * len(frame) for name in self.outputs}
        a = 0
        for key, b in zip(keys.tolist(), np.cumsum(np.bincount(codes)).tolist(), strict=True):
            state = self.op.load(json.loads(states[key])) if key in states else self.op.initial()
            use = a + np.flatnonzero(valid[a:b])
            found = self.op.run(state, x[use], y[use], True)
            states[key] = json.dumps(self.op.dump(state))
            for name in self.outputs:
                for at, value in zip(use.tolist(), found[name], strict=True):
                    value = value.item() if isinstance(value, np.generic) else value
                    values[name][at] = dict(value) if isinstance(value, list) else value
            a = b
        held.update((json.dumps(states),))
        yield pd.DataFrame({**{name: frame[name] for name in self.names}, **{name: pd.Series(v, dtype=object) for name, v in values.items()}})


def run_stream(df: DataFrame, op: Fold, layout: Layout) -> DataFrame:
    """``df``, a streaming frame, with the outputs of the test-then-train run; append mode.

    Without a key all rows have one owner.
    """
    use_rocksdb(df.sparkSession)
    names = list(df.columns)
    fields = [f for f in df.schema.fields]
    outputs = struct_of(op.output_ddl)
    keys = [F.col(f"`{k}`") for k in layout.key] or [F.lit(0)]
    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("__key")
    target = F.col(f"`{layout.target}`").cast("double") if layout.target else F.lit(0.0)
    dealt = df.select("*", key, vector([F.col(f"`{f}`") for f in layout.features]).alias("__x"), target.alias("__y"))
    dealt = dealt.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)).cast("int"))
    processor = _Processor(op, list(layout.order_by), len(layout.features), dealt.columns, names, outputs.fieldNames())
    return dealt.groupBy("__bucket").applyInPandasWithState(processor, T.StructType([*fields, *outputs.fields]), "payload string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there now and returns all it wrote (for tests and backfills of modest size)."""
    name = f"out_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a streaming frame over what is there now into Parquet; runs with the same checkpoint go on where the last one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_totals(stream: DataFrame, aggregates: list, key: list[str] | None = None) -> DataFrame:
    """Mergeable operators on a stream: their aggregates by key, for complete or update mode."""
    return stream.groupBy(*[F.col(f"`{k}`") for k in key or []]).agg(*aggregates)
