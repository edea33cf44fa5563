"""Naive Bayes: counts and moments by class.

The state of all three is sums over rows. ``fit`` builds it by one partial
aggregation; ``prequential`` and ``stream`` use the same state row by row.
Scoring is a projection: no shuffle and no Python worker.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expressions import bind, total, vector
from ebbflow.operators.base import Fitted, Sequential, apply_global
from ebbflow.operators.linear import with_state
from ebbflow.plans.layout import Layout, Names, masked


#: Numbers of a model that are written into expressions; longer ones would not be compiled well.
MOST_CONSTANTS = 64


def _log(value: float) -> Column:
    return F.lit(math.log(value) if value > 0 else None).cast("double")


class NaiveBayes(Sequential):
    """``classes`` holds a struct for each class in ascending order; ties go to the least label."""

    output_ddl = "y_pred int, proba map<int,double>"
    #: Arrays that a class keeps, besides ``label`` and ``n``.
    parts: tuple[str, ...] = ()
    part_type = "double"

    @property
    def state_ddl(self) -> str:
        return f"n bigint, classes array<struct<label:int,n:bigint,{','.join(f'{p}:array<{self.part_type}>' for p in self.parts)}>>"

    # -- aggregates

    def sums(self, x: list[Column]) -> dict[str, list[Column]]:
        """Aggregates of each part by feature."""
        raise NotImplementedError

    def log_likelihood(self, c: Column, x: Column) -> Column:
        raise NotImplementedError

    def terms(self, c: dict, x: list[Column]) -> list[Column]:
        """What ``log_likelihood`` adds up for each feature, given a class's numbers."""
        raise NotImplementedError

    def merged(self, d: int) -> dict[str, list[Column]]:
        """Aggregates that merge the rows ``n, <parts>`` of one class."""
        raise NotImplementedError

    def fit(self, df: DataFrame, features: Names = None, target: str | None = None, order_by: Names = None, key: Names = None, *, exclude: Names = None, state: DataFrame | None = None) -> FittedNaiveBayes:
        """One pass with partial aggregation; ``order_by`` makes no difference. Rows with a null feature or label take no part."""
        if target is None:
            raise ValueError(f"{type(self).__name__} needs a target")
        at = Layout.of(df, features, target, order_by, key, ordered=False, exclude=exclude)
        d = len(at.features)
        rows = masked(df, at.key, [F.col(f"`{f}`").cast("double") for f in at.features] + [F.col(f"`{target}`").cast("int")])
        parts = self.sums([F.col(f"__v{i}") for i in range(d)])
        label = F.col(f"__v{d}").cast("int").alias("__label")
        by_class = rows.groupBy(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(at.key)], label).agg(
            F.count(f"__v{d}").alias("__n"), *[v.alias(f"__{p}_{i}") for p, values in parts.items() for i, v in enumerate(values)]
        ).where("__n > 0")
        made = FittedNaiveBayes(self, at, self._gathered(by_class, at))
        return made if state is None else made.merge(FittedNaiveBayes(self, at, state))

    def _gathered(self, by_class: DataFrame, at: Layout) -> DataFrame:
        d = len(at.features)
        entry = F.struct(F.col("__label").alias("label"), F.col("__n").alias("n"), *[F.array(*[F.col(f"__{p}_{i}") for i in range(d)]).cast(f"array<{self.part_type}>").alias(p) for p in self.parts])
        keys = [F.col(f"`{k}`") for k in at.key]
        rows = by_class.groupBy(*keys).agg(F.sum("__n").alias("n"), F.array_sort(F.collect_list(entry)).alias("classes"))
        return rows.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("classes").cast(self.state_ddl.partition("classes ")[2]).alias("classes"))

    def scores(self, state_classes: Column, n: Column, x: Column) -> Column:
        """``array<struct<label, s>>`` of log joint probabilities."""
        return F.transform(state_classes, lambda c: F.struct(c["label"].alias("label"), (F.log(c["n"] / n) + self.log_likelihood(c, x)).alias("s")))

    def predict_columns(self, classes: Column, n: Column, x: Column) -> tuple[Column, Column]:
        """Predicted label and ``map<int, double>`` of probabilities."""
        scored = self.scores(classes, n, x)

        def softmax(s):
            top = F.array_max(F.transform(s, lambda e: e["s"]))
            grown = F.transform(s, lambda e: F.exp(e["s"] - top))
            return bind(F.struct(grown.alias("g"), total(grown).alias("t")), lambda b: F.map_from_arrays(F.transform(s, lambda e: e["label"]), F.transform(b["g"], lambda v: v / b["t"])))

        best = bind(scored, lambda s: F.array_min(F.transform(s, lambda e: F.struct((-e["s"]).alias("s"), e["label"].alias("label"))))["label"])
        learned = F.coalesce(n, F.lit(0)) > 0
        empty = F.create_map().cast("map<int,double>")
        return F.when(learned, best).otherwise(F.lit(0)), F.when(learned, bind(scored, softmax)).otherwise(empty)

    # -- row by row

    def initial(self) -> dict:
        return {"n": 0, "classes": {}}

    def start(self, d: int) -> dict[str, Any]:
        return {"n": 0, **{p: np.zeros(d) for p in self.parts}}

    def learn(self, c: dict, x: np.ndarray) -> None:
        raise NotImplementedError

    def score_many(self, c: dict, x: np.ndarray) -> np.ndarray:
        """Log likelihoods of rows in one class."""
        raise NotImplementedError

    def score_one(self, c: dict, x: np.ndarray) -> float:
        return float(self.score_many(c, x[None, :])[0])

    def one(self, state, x, y):
        label = int(y)
        c = state["classes"].get(label)
        if c is None:
            c = state["classes"][label] = self.start(len(x))
        c["n"] += 1
        state["n"] += 1
        self.learn(c, x)

    def _answer(self, state, x) -> tuple[int, dict[int, float]]:
        if not state["n"]:
            return 0, {}
        labels = sorted(state["classes"])
        s = np.array([math.log(state["classes"][k]["n"] / state["n"]) + self.score_one(state["classes"][k], x) for k in labels])
        e = np.exp(s - s.max())
        return labels[int(np.argmax(s))], dict(zip(labels, (e / e.sum()).tolist(), strict=True))

    def run(self, state, x, y, emit):
        out = []
        for row, label in zip(x, y, strict=True):
            if emit:
                out.append(self._answer(state, row))
            self.one(state, row, label)
        return {"y_pred": [o[0] for o in out], "proba": [list(o[1].items()) for o in out]}

    def apply(self, state, x):
        if not state["n"]:
            return {"y_pred": [0] * len(x), "proba": [[]] * len(x)}
        labels = sorted(state["classes"])
        s = np.stack([math.log(state["classes"][k]["n"] / state["n"]) + self.score_many(state["classes"][k], x) for k in labels], axis=1)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        shares = (e / e.sum(axis=1, keepdims=True)).tolist()
        return {"y_pred": [labels[k] for k in np.argmax(s, axis=1).tolist()], "proba": [list(zip(labels, row, strict=True)) for row in shares]}

    def dump(self, state):
        rows = [{"label": k, "n": c["n"], **{p: [self._number(v) for v in c[p].tolist()] for p in self.parts}} for k, c in sorted(state["classes"].items())]
        return {"n": state["n"], "classes": rows}

    def _number(self, v):
        return v

    def load(self, row):
        return {"n": row["n"], "classes": {c["label"]: {"n": c["n"], **{p: np.array(c[p], dtype=np.float64) for p in self.parts}} for c in row["classes"] or []}}


class FittedNaiveBayes(Fitted):
    """A learned model whose scoring stays in the JVM."""

    op: NaiveBayes

    def predict(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` with ``y_pred`` and ``proba``; label 0 and an empty map from an empty model.

        A single small model goes into the compiled expressions as constants, a
        larger one to numpy, and models by key meet their rows in a join.
        """
        if not self.layout.key:
            held = self.state.limit(1).collect()
            model = held[0].asDict(recursive=True) if held else {"n": 0, "classes": []}
            if len(model["classes"] or []) * len(self.layout.features) <= MOST_CONSTANTS:
                return self._unrolled(df, model)
            return apply_global(df, self.op, self.layout.features, df.sparkSession.createDataFrame(held, self.state.schema))
        x = vector([F.col(f"`{f}`") for f in self.layout.features])
        met = with_state(df, self.state.withColumnsRenamed({"n": "__n", "classes": "__classes"}), self.layout.key)
        label, proba = self.op.predict_columns(F.col("__classes"), F.col("__n"), F.col("__x"))
        known = F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v))
        out = met.withColumn("__x", x)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(known, label).alias("y_pred"), F.when(known, proba).alias("proba"))

    def _unrolled(self, df: DataFrame, model: dict) -> DataFrame:
        """A projection for each step: scores in compiled code, then their maximum and shares."""
        columns, d = [F.col(f"`{c}`") for c in df.columns], len(self.layout.features)
        rows = df.select("*", *[F.col(f"`{f}`").cast("double").alias(f"__nb_v{i}") for i, f in enumerate(self.layout.features)])
        known = " AND ".join(f"__nb_v{i} IS NOT NULL AND NOT isnan(__nb_v{i})" for i in range(d)) or "true"
        classes = sorted(model["classes"] or [], key=lambda c: c["label"])
        if not model["n"]:
            return rows.select(*columns, F.expr(f"CASE WHEN {known} THEN 0 END AS y_pred"), F.expr(f"CASE WHEN {known} THEN CAST(map() AS map<int,double>) END AS proba"))
        x = [F.col(f"__nb_v{i}") for i in range(d)]
        scores = [F.lit(math.log(c["n"] / model["n"])) + reduce(add, self.op.terms(c, x), F.lit(0.0)) for c in classes]
        # one array each: a filter on the result that Spark pushes down copies few expressions
        rows = rows.select(*columns, F.expr(f"{known} AS __nb_known"), F.array(*scores).alias("__nb_s"))
        rows = rows.selectExpr("*", "array_max(__nb_s) AS __nb_top")
        rows = rows.selectExpr("*", "transform(__nb_s, v -> exp(v - __nb_top)) AS __nb_g")
        rows = rows.selectExpr("*", "aggregate(__nb_g, 0D, (a, v) -> a + v) AS __nb_sum")
        labels = f"array({', '.join(str(c['label']) for c in classes)})"
        best = f"CASE WHEN __nb_known THEN coalesce(get({labels}, CAST(array_position(__nb_s, __nb_top) - 1 AS int)), {classes[0]['label']}) END AS y_pred"
        return rows.select(*columns, F.expr(best), F.expr(f"CASE WHEN __nb_known THEN map_from_arrays({labels}, transform(__nb_g, v -> v / __nb_sum)) END AS proba"))

    def by_class(self) -> DataFrame:
        """Key columns, ``label``, ``n`` and a row for each feature: ``feature`` (from 0) and the parts."""
        keys = [F.col(f"`{k}`") for k in self.layout.key]
        rows = self.state.select(*keys, F.explode("classes").alias("c"))
        zipped = F.arrays_zip(*[F.col(f"c.{p}").alias(p) for p in self.op.parts])
        return rows.select(*keys, "c.label", "c.n", F.posexplode(zipped).alias("feature", "__z")).select(*keys, "label", "n", "feature", *[F.col(f"__z.{p}").alias(p) for p in self.op.parts])

    def classes(self) -> DataFrame:
        return self.class_prior().drop("prior")

    def class_prior(self) -> DataFrame:
        """Key columns, ``label`` and ``prior``: the class's share of rows."""
        keys = [F.col(f"`{k}`") for k in self.layout.key]
        return self.state.select(*keys, "n", F.explode("classes").alias("c")).select(*keys, "c.label", (F.col("c.n") / F.col("n")).alias("prior"))

    def merge(self, other: Fitted) -> FittedNaiveBayes:
        """The model of both models' rows."""
        d = len(self.layout.features)
        keys = [F.col(f"`{k}`") for k in self.layout.key]
        rows = self.state.unionByName(other.state).select(*keys, F.explode("classes").alias("c")).select(*keys, F.col("c.label").alias("__label"), "c.n", *[F.col(f"c.{p}").alias(p) for p in self.op.parts])
        summed = rows.groupBy(*keys, "__label").agg(F.sum("n").alias("__n"), *[v.alias(f"__{p}_{i}") for p, values in self.op.merged(d).items() for i, v in enumerate(values)])
        return FittedNaiveBayes(self.op, self.layout, self.op._gathered(summed, self.layout))

    def update(self, df: DataFrame) -> FittedNaiveBayes:
        return self.merge(self.op.fit(df, self.layout.features, self.layout.target, None, self.layout.key))


class GaussianNB(NaiveBayes):
    """Normal densities by class and feature. A feature without spread in a class, or with one row, is left out of its score."""

    parts = ("mean", "m2")

    def sums(self, x):
        count = F.count("*")
        return {"mean": [F.avg(v) for v in x], "m2": [F.var_pop(v) * count for v in x]}

    def merged(self, d):
        at = lambda p, i: F.get(F.col(p), F.lit(i))
        mean = [F.sum(F.col("n") * at("mean", i)) / F.sum("n") for i in range(d)]
        m2 = [F.sum(at("m2", i)) + F.greatest(F.sum(F.col("n") * at("mean", i) * at("mean", i)) - F.sum("n") * mean[i] * mean[i], F.lit(0.0)) for i in range(d)]
        return {"mean": mean, "m2": m2}

    def log_likelihood(self, c, x):
        def term(v, s):
            var = s["m2"] / (c["n"] - 1)
            gap = v - s["mean"]
            return F.when((c["n"] > 1) & (var > 0), F.lit(-0.5) * (F.log(F.lit(2 * math.pi) * var) + gap * gap / var)).otherwise(0.0)

        return total(F.zip_with(x, F.arrays_zip(c["mean"].alias("mean"), c["m2"].alias("m2")), term))

    def terms(self, c, x):
        out = []
        for v, mean, m2 in zip(x, c["mean"], c["m2"], strict=True):
            var = m2 / (c["n"] - 1) if c["n"] > 1 else 0.0
            if var > 0:
                gap = v - F.lit(mean)
                out.append(F.lit(-0.5) * (F.lit(math.log(2 * math.pi * var)) + gap * gap / F.lit(var)))
        return out

    def learn(self, c, x):
        gap = x - c["mean"]
        c["mean"] = c["mean"] + gap / c["n"]
        c["m2"] = c["m2"] + gap * (x - c["mean"])

    def score_many(self, c, x):
        if c["n"] < 2:
            return np.zeros(len(x))
        var = c["m2"] / (c["n"] - 1)
        ok = var > 0
        gap = (x - c["mean"])[:, ok]
        return -0.5 * (np.log(2 * math.pi * var[ok]) + gap * gap / var[ok]).sum(axis=1)


class BernoulliNB(NaiveBayes):
    """A feature is on if it exceeds 0; smoothed by ``alpha``."""

    parts = ("on",)
    part_type = "bigint"

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def sums(self, x):
        return {"on": [F.count_if(v > 0) for v in x]}

    def merged(self, d):
        return {"on": [F.sum(F.get("on", F.lit(i))) for i in range(d)]}

    def log_likelihood(self, c, x):
        def term(v, on):
            p = (on + self.alpha) / (c["n"] + 2 * self.alpha)
            return F.when(v > 0, F.log(p)).otherwise(F.log(1 - p))

        return total(F.zip_with(x, c["on"], term))

    def terms(self, c, x):
        p = [(on + self.alpha) / (c["n"] + 2 * self.alpha) for on in c["on"]]
        return [F.when(v > 0, _log(q)).otherwise(_log(1 - q)) for v, q in zip(x, p, strict=True)]

    def learn(self, c, x):
        c["on"] = c["on"] + (x > 0)

    def score_many(self, c, x):
        p = (c["on"] + self.alpha) / (c["n"] + 2 * self.alpha)
        return np.where(x > 0, np.log(p), np.log(1 - p)).sum(axis=1)

    def _number(self, v):
        return int(v)


class MultinomialNB(NaiveBayes):
    """Counts, which may be fractions; smoothed by ``alpha``."""

    parts = ("total",)

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def sums(self, x):
        return {"total": [F.sum(v) for v in x]}

    def merged(self, d):
        return {"total": [F.sum(F.get("total", F.lit(i))) for i in range(d)]}

    def log_likelihood(self, c, x):
        def of(whole):
            def term(v, t):
                theta = (t + self.alpha) / whole
                return F.when((theta > 0) & (v > 0), v * F.log(theta)).otherwise(0.0)

            return total(F.zip_with(x, c["total"], term))

        return bind(total(c["total"]) + self.alpha * F.size(c["total"]), of)

    def terms(self, c, x):
        whole = sum(c["total"]) + self.alpha * len(x)
        theta = [(t + self.alpha) / whole for t in c["total"]]
        return [F.when(v > 0, v * _log(q)).otherwise(0.0) for v, q in zip(x, theta, strict=True) if q > 0]

    def learn(self, c, x):
        c["total"] = c["total"] + x

    def score_many(self, c, x):
        theta = (c["total"] + self.alpha) / (c["total"].sum() + self.alpha * x.shape[1])
        ok = theta > 0
        return np.where(x[:, ok] > 0, x[:, ok] * np.log(theta[ok]), 0.0).sum(axis=1)
