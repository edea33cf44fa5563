"""Bagging by Poisson resampling. Members are independent, so each is a fold of its own.

How often a member learns a row is a function of seed, member and the row's
place, not of a shared random stream: results don't depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expressions import poisson
from ebbflow.operators.base import Sequential, apply_global
from ebbflow.operators.compose import struct_ddl
from ebbflow.operators.drift import ADWIN, Detector
from ebbflow.plans.fold import fold, struct_of
from ebbflow.plans.layout import Layout, Names


def _as_map(output: dict[str, Any], n: int) -> list[list[tuple[int, float]]]:
    """Probabilities of any learner as lists of pairs; empty where it has none."""
    proba = output.get("proba")
    if proba is None:
        return [[] for _ in range(n)]
    out = []
    for p in proba:
        if p is None:
            out.append([])
        elif isinstance(p, list):
            out.append(p)
        else:
            out.append([(0, 1 - float(p)), (1, float(p))])
    return out


class Member(Sequential):
    """A base learner that takes the number of repetitions as its last feature."""

    output_ddl = "y_pred int, proba map<int,double>"

    def __init__(self, base: Sequential):
        self.base = base
        self.state_ddl = f"n bigint, drifts bigint, base {struct_ddl(base.state_ddl)}"

    def initial(self):
        return {"n": 0, "drifts": 0, "base": self.base.initial()}

    def _answers(self, state, x) -> tuple[list, list]:
        found = self.base.apply(state["base"], x)
        return [int(v) for v in found["y_pred"]], _as_map(found, len(x)) if self._learned(state) else [[] for _ in x]

    def _learned(self, state) -> bool:
        return self.base.seen(state["base"]) > 0 if not (isinstance(state["base"], dict) and "__new" in state["base"]) else False

    def run(self, state, x, y, emit):
        times, rows = x[:, -1].astype(np.int64), x[:, :-1]
        if not emit:
            self.base.run(state["base"], np.repeat(rows, times, axis=0), np.repeat(y, times), False)
            state["n"] += len(x)
            return {}
        predicted, shares = [], []
        for row, label, k in zip(rows, y, times.tolist(), strict=True):
            p, s = self._answers(state, row[None, :])
            predicted += p
            shares += s
            if k:
                self._learn(state, row, label, k)
            state["n"] += 1
        return {"y_pred": predicted, "proba": shares}

    def _learn(self, state, row, label, k):
        self.base.run(state["base"], np.repeat(row[None, :], k, axis=0), np.repeat(label, k), False)

    def apply(self, state, x):
        predicted, shares = self._answers(state, x[:, :-1])
        return {"y_pred": predicted, "proba": shares}

    def dump(self, state):
        return {"n": state["n"], "drifts": state["drifts"], "base": self.base.dump(state["base"])}

    def load(self, row):
        return {"n": row["n"], "drifts": row["drifts"], "base": self.base.load(row["base"])}


class WatchedMember(Member):
    """A member with detectors of drift and warning on its errors before learning, and a learner in the background from a warning on."""

    def __init__(self, base: Sequential, detector: Detector):
        super().__init__(base)
        self.detector = detector
        kind, watch = struct_ddl(base.state_ddl), struct_ddl(detector.state_ddl)
        self.state_ddl = f"n bigint, drifts bigint, base {kind}, drift {watch}, warning {watch}, in_warning boolean, other {kind}"

    def initial(self):
        return {**super().initial(), "drift": self.detector.initial(), "warning": self.detector.initial(), "in_warning": False, "other": None}

    def run(self, state, x, y, emit):
        if emit:
            return super().run(state, x, y, True)
        for row, label, k in zip(x[:, :-1], y, x[:, -1].astype(np.int64).tolist(), strict=True):
            if k:
                self._learn(state, row, label, k)
            state["n"] += 1
        return {}

    def _learn(self, state, row, label, k):
        predicted = int(self.base.apply(state["base"], row[None, :])["y_pred"][0])
        error = float(predicted != label)
        super()._learn(state, row, label, k)
        drift = self.detector.update(state["drift"], error)
        warning = self.detector.update(state["warning"], error)
        if warning == 1 and not state["in_warning"]:
            state["in_warning"], state["other"] = True, self.base.initial()
        if state["other"] is not None:
            self.base.run(state["other"], np.repeat(row[None, :], k, axis=0), np.repeat(label, k), False)
        if drift == 2:
            state["drifts"] += 1
            state["base"] = state["other"] if state["other"] is not None else self.base.initial()
            state.update(drift=self.detector.initial(), warning=self.detector.initial(), in_warning=False, other=None)

    def dump(self, state):
        other = None if state["other"] is None else self.base.dump(state["other"])
        watch = {k: self.detector.dump(state[k]) for k in ("drift", "warning")}
        return {**super().dump(state), **watch, "in_warning": state["in_warning"], "other": other}

    def load(self, row):
        other = None if row["other"] is None else self.base.load(row["other"])
        return {**super().load(row), "drift": self.detector.load(row["drift"]), "warning": self.detector.load(row["warning"]), "in_warning": row["in_warning"], "other": other}


class Bagging:
    """``n_estimators`` copies of a learner, each fed every row a Poisson number of times; majority vote, least label of equals."""

    default_rate = 1.0

    def __init__(self, base: Sequential, n_estimators: int = 10, rate: float | None = None, seed: int = 1):
        rate = self.default_rate if rate is None else rate
        if n_estimators <= 0 or not (0 < rate < float("inf")):
            raise ValueError("n_estimators and rate must be positive, rate finite")
        self.base, self.n_estimators, self.rate, self.seed = base, n_estimators, rate, seed
        self.member = self._member()

    def _member(self) -> Member:
        return Member(self.base)

    def times(self, member: Column, order_by: tuple[str, ...]) -> Column:
        """How often a member learns a row."""
        return poisson(self.rate, self.seed, member, F.xxhash64(*[F.col(f"`{o}`") for o in order_by]))

    def _dealt(self, df: DataFrame, at: Layout) -> tuple[DataFrame, Layout]:
        """A row for each row and member; the whole row goes with member 0 alone."""
        members = F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1))).alias("__member")
        wide = df.select(
            *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(at.key)], *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(at.order_by)],
            *[F.col(f"`{f}`").cast("double").alias(f"__f{i}") for i, f in enumerate(at.features)], *([F.col(f"`{at.target}`").cast("double").alias("__t")] if at.target else []),
            F.struct("*").alias("__whole"), members,
        )
        keys, orders = tuple(f"__k{i}" for i in range(len(at.key))), tuple(f"__o{i}" for i in range(len(at.order_by)))
        dealt = wide.withColumns({"__times": self.times(F.col("__member"), orders).cast("double"), "__whole": F.when(F.col("__member") == 0, F.col("__whole"))})
        return dealt, Layout((*[f"__f{i}" for i in range(len(at.features))], "__times"), "__t" if at.target else None, orders, (*keys, "__member"))

    def _voted(self, rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        met = rows.groupBy(*by).agg(F.max_by("__whole", F.when(F.col("__member") == 0, 1)).alias("__whole"), F.collect_list("y_pred").alias("__v"), F.collect_list("proba").alias("__p"))
        votes = F.transform(F.array_distinct("__v"), lambda c: F.struct((-F.size(F.filter("__v", lambda v: v == c))).alias("n"), c.alias("c")))
        issued = F.filter("__p", lambda p: F.size(p) > 0)
        labels = F.array_sort(F.array_distinct(F.flatten(F.transform(issued, F.map_keys))))
        mean = lambda c: F.aggregate(issued, F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at(p, c), F.lit(0.0))) / F.size(issued)
        proba = F.map_from_arrays(labels, F.transform(labels, mean))
        return met.select(*[F.col(f"__whole.`{c}`").alias(c) for c in columns], F.array_min(votes)["c"].alias("y_pred"), proba.alias("proba"))

    def prequential(self, df: DataFrame, features: Names, target: str, order_by: Names, key: Names = None) -> DataFrame:
        """All columns of ``df``, the vote before each row was learned, and mean probabilities of the members that have any."""
        at = Layout.of(df, features, target, order_by, key)
        dealt, inner = self._dealt(df, at)
        rows = fold(dealt, self.member, inner, "run")
        return self._voted(rows, [k for k in inner.key if k != "__member"] + list(inner.order_by), df.columns)

    def fit(self, df: DataFrame, features: Names, target: str, order_by: Names, key: Names = None) -> FittedBagging:
        at = Layout.of(df, features, target, order_by, key)
        dealt, inner = self._dealt(df, at)
        return FittedBagging(self, at, fold(dealt, self.member, inner, "fit"))


class HighRatePoissonBagging(Bagging):
    """Bagging at rate 6."""

    default_rate = 6.0


LeveragingBagging = HighRatePoissonBagging


class DriftAwareBagging(Bagging):
    """Bagging at rate 6 whose members replace themselves when their errors drift."""

    default_rate = 6.0

    def __init__(self, base: Sequential, detector: Detector | None = None, n_estimators: int = 10, rate: float | None = None, seed: int = 1):
        self.detector = detector or ADWIN()
        super().__init__(base, n_estimators, rate, seed)

    def _member(self):
        return WatchedMember(self.base, self.detector)


AdaptiveRandomForest = DriftAwareBagging


class _Votes(Sequential):
    """All members at once."""

    output_ddl = "y_pred int, proba map<int,double>"

    def __init__(self, member: Member, rows: list[dict]):
        self.member, self.rows = member, rows

    def initial(self):
        return [self.member.load(row) for row in self.rows]

    def apply(self, state, x):
        if not state:
            return {"y_pred": [0] * len(x), "proba": [[] for _ in x]}
        padded = np.concatenate((x, np.zeros((len(x), 1))), axis=1)
        found = [self.member.apply(s, padded) for s in state]
        predicted, shares = [], []
        for i in range(len(x)):
            said = [int(f["y_pred"][i]) for f in found]
            predicted.append(min(set(said), key=lambda c: (-said.count(c), c)))
            issued = [dict(f["proba"][i]) for f in found if f["proba"][i]]
            shares.append([(c, sum(p.get(c, 0.0) for p in issued) / len(issued)) for c in sorted({c for p in issued for c in p})])
        return {"y_pred": predicted, "proba": shares}


@dataclass
class FittedBagging:
    """``state``: a row for each member of each key."""

    op: Bagging
    layout: Layout
    state: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """All columns of ``df``, the vote and the mean probabilities.

        Without a key the members' states, ``n_estimators`` rows, go to the
        tasks; with one, rows meet the states of their key and member.
        """
        if not self.layout.key:
            names = struct_of(self.op.member.state_ddl).fieldNames()
            rows = [{n: r[n] for n in names} for r in (row.asDict(recursive=True) for row in self.state.orderBy("__member").collect())]
            return apply_global(df, _Votes(self.op.member, rows), self.layout.features, None)
        numbered = df.withColumn("__id", F.struct(F.monotonically_increasing_id()))
        at = replace(self.layout, target=None, order_by=("__id",))
        dealt, inner = self.op._dealt(numbered, at)
        rows = fold(dealt, self.op.member, replace(inner, order_by=()), "apply", self.state)
        return self.op._voted(rows, list(inner.order_by), df.columns)

    def per_learner_drifts(self) -> DataFrame:
        keys = [F.col(f"__k{i}").alias(k) for i, k in enumerate(self.layout.key)]
        return self.state.select(*keys, F.col("__member").alias("member"), "drifts")

    per_tree_drifts = per_learner_drifts

    def total_drifts(self) -> DataFrame:
        keys = [F.col(f"__k{i}").alias(k) for i, k in enumerate(self.layout.key)]
        return self.state.groupBy(*keys).agg(F.sum("drifts").alias("drifts"))


__all__ = ["AdaptiveRandomForest", "Bagging", "DriftAwareBagging", "FittedBagging", "HighRatePoissonBagging", "LeveragingBagging", "Member", "WatchedMember", "struct_of"]
