"""Generators as a Python data source: ``spark.read.format("ebbflow_generator")``, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ebbflow.sources.generators import SEA_THRESHOLDS

SCHEMA = "seq long, x array<double>, y int"


def _uniform(seed: int, rows: np.ndarray, k: int) -> np.ndarray:
    """Uniform in [0, 1) for each row number: a splitmix64 hash."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x632BE59BD9B4E019 + k * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sea_rows(first: int, last: int, function_id: int = 1, noise: float = 0.1, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``first`` to ``last - 1`` of a SEA stream."""
    rows = np.arange(first, last)
    x = np.stack([_uniform(seed, rows, k) * 10 for k in range(3)], axis=1)
    y = (x[:, 0] + x[:, 1] > SEA_THRESHOLDS[function_id - 1]).astype(np.int64)
    return rows, x, np.where(_uniform(seed, rows, 3) < noise, 1 - y, y)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Settings:
    def __init__(self, options: dict[str, str]):
        self.n, self.partitions = int(options.get("n", 1000)), int(options.get("partitions", 4))
        self.per_batch = int(options.get("rowsperbatch", options.get("rowsPerBatch", 1000)))
        self.rule = {"function_id": int(options.get("function_id", 1)), "noise": float(options.get("noise", 0.1)), "seed": int(options.get("seed", 1))}


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self):
        s = self.settings
        bounds = [1 + s.n * k // s.partitions for k in range(s.partitions + 1)]
        return [_Range(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.last, 8192):
            rows, x, y = sea_rows(first, min(partition.last, first + 8192), **self.settings.rule)
            bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(bounds, pa.array(x.ravel())), pa.array(y.astype(np.int32))], ["seq", "x", "y"])


class _StreamReader(SimpleDataSourceStreamReader):
    """Row numbers are offsets: a batch that is read again has the same rows."""

    def __init__(self, settings: _Settings):
        self.settings = settings

    def initialOffset(self):
        return {"next": 1}

    def _rows(self, first: int, last: int):
        rows, x, y = sea_rows(first, last, **self.settings.rule)
        return iter(list(zip(rows.tolist(), x.tolist(), y.tolist(), strict=True)))

    def read(self, start):
        last = min(self.settings.n + 1, start["next"] + self.settings.per_batch)
        return self._rows(start["next"], last), {"next": last}

    def readBetweenOffsets(self, start, end):
        return self._rows(start["next"], end["next"])


class GeneratorSource(DataSource):
    """Options: ``n``, ``partitions``, ``rowsPerBatch``, ``function_id``, ``noise``, ``seed``."""

    @classmethod
    def name(cls):
        return "ebbflow_generator"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(_Settings(self.options))

    def simpleStreamReader(self, schema):
        return _StreamReader(_Settings(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeneratorSource)
