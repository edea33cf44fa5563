"""Synthetic streams.

Each generator is a function of the row number: values come from hashes of seed
and row number, so a stream is the same whatever its partitioning, and any part
of it can be made alone. ``columns`` gives the expressions, which also work on a
streaming rate source; ``frame`` gives ``seq, x, y`` for rows 1 to n.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.expressions import bind, dot, normal, total, uniform


class Generator:
    """``columns(seq)`` returns ``x`` (``array<double>``) and ``y``."""

    seed: int

    def columns(self, seq: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def frame(self, spark: SparkSession, n: int, start: int = 1) -> DataFrame:
        rows = spark.range(start, start + n).select(F.col("id").alias("seq"))
        x, y = self.columns(F.col("seq"))
        return rows.select("seq", x.alias("x"), y.alias("y"))

    def wide(self, spark: SparkSession, n: int, d: int) -> DataFrame:
        """``seq, x0, x1, ..., y``."""
        rows = spark.range(1, 1 + n).select(F.col("id").alias("seq"))
        x, y = self.columns(F.col("seq"))
        return rows.select("seq", *[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(d)], y.alias("y"))


@dataclass(frozen=True)
class SineGenerator(Generator):
    """``x = [t]``, ``y = amplitude * sin(frequency * t)`` and normal noise."""

    amplitude: float = 1.0
    frequency: float = 0.1
    noise: float = 0.1
    seed: int = 1

    def columns(self, seq):
        y = F.lit(self.amplitude) * F.sin(F.lit(self.frequency) * seq) + F.lit(self.noise) * normal(self.seed, seq)
        return F.array(seq.cast("double")), y


@dataclass(frozen=True)
class RandomRBFGenerator(Generator):
    """Weighted centroids in the unit cube, each with a class from 1; rows scatter about them by 0.1."""

    n_classes: int = 2
    n_features: int = 10
    n_centroids: int = 50
    seed: int = 1

    def centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, classes and cumulative weights; a fixed number of rows, drawn on the driver."""
        rng = np.random.default_rng(self.seed)
        places = rng.random((self.n_centroids, self.n_features))
        classes = rng.integers(1, self.n_classes + 1, self.n_centroids)
        weights = rng.random(self.n_centroids)
        return places, classes, np.cumsum(weights / weights.sum())

    def _chosen(self, seq: Column) -> Column:
        """Number of a row's centroid, from 0."""
        u = uniform(self.seed, seq, -1)
        return reduce(operator.add, [(u >= float(v)).cast("int") for v in self.centroids()[2][:-1]], F.lit(0))

    def _around(self, seq: Column, chosen: Column) -> tuple[list[Column], Column]:
        places, classes, _ = self.centroids()
        pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), chosen)
        return [pick(map(float, places[:, j])) + 0.1 * normal(self.seed, seq, j) for j in range(self.n_features)], pick(map(int, classes))

    def columns(self, seq):
        x, y = self._around(seq, self._chosen(seq))
        return F.array(*x), y

    def drawn_columns(self, seq: Column, epoch: Column) -> tuple[Column, Column]:
        """``columns`` with places, classes and weights that are themselves functions of ``epoch`` and the centroid's number."""
        of = self.seed * 1009 + 7
        weights = F.array(*[uniform(of, epoch, c, -1) for c in range(self.n_centroids)])

        def choose(w: Column) -> Column:
            aim = uniform(self.seed, seq, -1) * total(w)
            start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
            walked = F.aggregate(w, start, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["k"] + (a["s"] + v <= aim).cast("int")).alias("k")))
            return F.least(walked["k"], F.lit(self.n_centroids - 1))

        chosen = bind(weights, choose)
        x = [uniform(of, epoch, chosen, j) + 0.1 * normal(self.seed, seq, j) for j in range(self.n_features)]
        return F.array(*x), (F.floor(uniform(of, epoch, chosen, -2) * self.n_classes) + 1).cast("int")

    def wide(self, spark, n, d):
        """In steps, as one compiled method for all would be too long to be optimised, and written out, as Spark parses faster than Python builds columns."""
        places, classes, weights = self.centroids()
        drawn = lambda *parts: f"cast(shiftrightunsigned(xxhash64({', '.join(f'cast({p} AS bigint)' for p in (self.seed, *parts))}), 11) AS double) / {float(1 << 53)!r}D"
        pick = lambda values, mark="": f"get(array({', '.join(f'{v!r}{mark}' for v in values)}), chosen)"
        noise = lambda j: f"sqrt(-2D * ln(1D - {drawn('seq', j, 0)})) * cos({2 * math.pi!r}D * ({drawn('seq', j, 1)}))"
        rows = spark.range(1, 1 + n).selectExpr("id AS seq").selectExpr("seq", f"{drawn('seq', -1)} AS u")
        below = " ".join(f"WHEN u < {float(w)!r}D THEN {k}" for k, w in enumerate(weights[:-1]))
        rows = rows.selectExpr("seq", f"CASE {below} ELSE {len(weights) - 1} END AS chosen")
        return rows.selectExpr("seq", *[f"{pick(map(float, places[:, j]), 'D')} + 0.1D * ({noise(j)}) AS x{j}" for j in range(min(d, self.n_features))], f"{pick(map(int, classes))} AS y")


@dataclass(frozen=True)
class ConceptDriftStream(Generator):
    """A base generator that is drawn anew at every multiple of ``drift_interval``, without end; generators without drawn parameters stay as they are."""

    base: Generator
    drift_interval: int = 1000
    drift_type: str = "sudden"
    seed: int = 1

    def __post_init__(self):
        if self.drift_type != "sudden":
            raise NotImplementedError("only sudden drift is defined")

    def columns(self, seq):
        if not isinstance(self.base, RandomRBFGenerator):
            return self.base.columns(seq)
        return self.base.drawn_columns(seq, F.floor(seq / self.drift_interval).cast("bigint"))


#: Segments of a seven-segment display for the digits 0 to 9 (top, top right, bottom right, bottom, bottom left, top left, middle).
LED_SEGMENTS = ("1111110", "0110000", "1101101", "1111001", "0110011", "1011011", "1011111", "1110000", "1111111", "1111011")


def led_pattern(digit: Column) -> Column:
    """Segments of a digit as ``array<double>``."""
    return F.transform(F.split(F.get(F.array(*[F.lit(s) for s in LED_SEGMENTS]), digit), ""), lambda c: c.cast("double"))


@dataclass(frozen=True)
class LEDGenerator(Generator):
    """Segments of a random digit, each flipped with probability ``noise``, and 17 random bits."""

    noise: float = 0.1
    irrelevant_features: bool = True
    seed: int = 1

    def columns(self, seq):
        digit = F.floor(uniform(self.seed, seq, -1) * 10).cast("int")
        flips = F.array(*[uniform(self.seed, seq, j) < self.noise for j in range(7)])
        x = F.zip_with(led_pattern(digit), flips, lambda v, f: F.when(f, 1.0 - v).otherwise(v))
        if self.irrelevant_features:
            x = F.concat(x, F.array(*[F.when(uniform(self.seed, seq, 7 + j) < 0.5, 1.0).otherwise(0.0) for j in range(17)]))
        return x, digit


def agrawal_label(function_id: int, salary: Column, age: Column, elevel: Column, car: Column, hvalue: Column, hyears: Column, loan: Column) -> Column:
    """Class 0 where the predicate holds, else 1."""
    rules = {
        1: (age < 40) & (salary < 50_000),
        2: (age < 40) & salary.between(50_000, 100_000),
        3: age.between(40, 60) & (salary < 75_000),
        4: age.between(40, 60) & salary.between(75_000, 125_000),
        5: (age > 60) & (salary < 100_000),
        6: (salary < 50_000) & elevel.isin(0, 1),
        7: (salary >= 75_000) & (elevel >= 3),
        8: age.between(25, 45) & ((car <= 5) | (car >= 15)),
        9: (hvalue >= 200_000) & (hyears >= 10),
        10: (loan < 150_000) & (hvalue >= 300_000),
    }
    return F.when(rules[function_id], 0).otherwise(1)


@dataclass(frozen=True)
class AgrawalGenerator(Generator):
    """Nine attributes of a person; the label follows one of ten predicates on unperturbed values."""

    function_id: int = 1
    perturbation: float = 0.05
    seed: int = 1

    def __post_init__(self):
        if self.function_id not in range(1, 11):
            raise ValueError("function_id must be 1 to 10")

    def attributes(self, seq: Column) -> dict[str, Column]:
        u = lambda k: uniform(self.seed, seq, k)
        whole = lambda k, low, high: (F.floor(u(k) * (high - low + 1)) + low).cast("double")
        zipcode = whole(6, 0, 8)
        return {
            "salary": 20_000.0 + 130_000.0 * u(0), "commission": F.when(u(1) < 0.5, 0.0).otherwise(10_000.0 + 65_000.0 * u(2)), "age": whole(3, 20, 80),
            "elevel": whole(4, 0, 4), "car": whole(5, 1, 20), "zipcode": zipcode, "hvalue": 50_000.0 + 450_000.0 * u(7) + 100_000.0 * zipcode,
            "hyears": whole(8, 1, 30), "loan": u(9) * 500_000.0,
        }

    def columns(self, seq):
        a = self.attributes(seq)
        y = agrawal_label(self.function_id, a["salary"], a["age"], a["elevel"], a["car"], a["hvalue"], a["hyears"], a["loan"])
        x = F.array(*[v * (1.0 + self.perturbation * (2 * uniform(self.seed, seq, 20 + j) - 1)) for j, v in enumerate(a.values())])
        return x, y


#: Thresholds of the four concepts.
SEA_THRESHOLDS = (8.0, 9.0, 7.0, 9.5)


def sea_label(function_id: int, x1: Column, x2: Column) -> Column:
    return F.when(x1 + x2 <= SEA_THRESHOLDS[function_id - 1], 0).otherwise(1)


@dataclass(frozen=True)
class SEAGenerator(Generator):
    """Three features in [0, 10]; the label depends on the sum of two and is flipped with probability ``noise``."""

    function_id: int = 1
    noise: float = 0.1
    seed: int = 1

    def __post_init__(self):
        if self.function_id not in range(1, 5):
            raise ValueError("function_id must be 1 to 4")

    def columns(self, seq):
        x = [uniform(self.seed, seq, j) * 10 for j in range(3)]
        y = sea_label(self.function_id, x[0], x[1])
        return F.array(*x), F.when(uniform(self.seed, seq, 3) < self.noise, 1 - y).otherwise(y)


@dataclass(frozen=True)
class HyperplaneGenerator(Generator):
    """Points of the unit cube on either side of a hyperplane through its middle.

    With ``mag_change`` the first ``n_drift_features`` weights take a step up or
    down after every row, clamped to [0, 1]. A clamped walk does not compose, so
    ``frame`` walks them through the rows in one task; ``columns`` is for ``mag_change = 0``.
    """

    n_features: int = 10
    n_drift_features: int = 2
    mag_change: float = 0.0
    noise: float = 0.05
    seed: int = 1

    def weights(self) -> np.ndarray:
        return np.random.default_rng(self.seed).random(self.n_features)

    def _row(self, seq: Column, w: Column) -> tuple[Column, Column]:
        x = F.array(*[uniform(self.seed, seq, j) for j in range(self.n_features)])
        y = bind(w, lambda v: F.when(dot(v, x) >= total(v) / 2, 1).otherwise(0))
        return x, F.when(uniform(self.seed, seq, -1) < self.noise, 1 - y).otherwise(y)

    def columns(self, seq):
        if self.mag_change:
            raise NotImplementedError("drifting weights depend on the rows before; use frame")
        return self._row(seq, F.array(*[F.lit(float(w)) for w in self.weights()]))

    def frame(self, spark, n, start=1):
        if not self.mag_change:
            return super().frame(spark, n, start)
        k = min(self.n_drift_features, self.n_features)
        seed, first, step = self.seed, self.weights(), self.mag_change
        ups = [F.when(uniform(seed, F.col("seq"), -2 - j) < 0.5, -1.0).otherwise(1.0).alias(f"d{j}") for j in range(k)]
        rows = spark.range(1, start + n).select(F.col("id").alias("seq"), *ups)

        def walk(batches):
            import pyarrow as pa

            w = first.copy()
            for batch in batches:
                at = batch.column(0).to_pylist()
                turns = np.stack([batch.column(1 + j).to_numpy(zero_copy_only=False) for j in range(k)], axis=1)
                out = []
                for turn in turns:
                    out.append(w.tolist())
                    w[:k] = np.clip(w[:k] + turn * step, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["seq", "w"])

        walked = rows.repartition(1).sortWithinPartitions("seq").mapInArrow(walk, "seq long, w array<double>").where(F.col("seq") >= start)
        x, y = self._row(F.col("seq"), F.col("w"))
        return walked.select("seq", x.alias("x"), y.alias("y"))


GENERATORS = {
    "sine": SineGenerator, "rbf": RandomRBFGenerator, "led": LEDGenerator, "agrawal": AgrawalGenerator, "sea": SEAGenerator, "hyperplane": HyperplaneGenerator,
}


def iterate_stream(spark: SparkSession, generator: Generator, n: int) -> DataFrame:
    """``n`` rows of a generator."""
    return generator.frame(spark, n)


def endless(spark: SparkSession, generator: Generator, rows_per_second: int = 1000) -> DataFrame:
    """A generator without end, as a streaming frame ``timestamp, seq, x, y``."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    x, y = generator.columns(F.col("value") + 1)
    return rate.select("timestamp", (F.col("value") + 1).alias("seq"), x.alias("x"), y.alias("y"))
