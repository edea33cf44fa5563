"""Pipelines, column-wise composition and drift-triggered retraining."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.base import Sequential
from ebbflow.operators.drift import DRIFT, WARNING, Detector
from ebbflow.operators.transform import FittedScaler, Scaler
from ebbflow.plans.fold import struct_of
from ebbflow.plans.layout import Names

_SCALER_DDL = {
    "StandardScaler": "struct<n:bigint,mean:array<double>,m2:array<double>>",
    "MinMaxScaler": "struct<n:bigint,low:array<double>,high:array<double>>",
    "MaxAbsScaler": "struct<n:bigint,top:array<double>>",
}


def struct_ddl(ddl: str) -> str:
    """A column list as the type of one struct."""
    return struct_of(ddl).simpleString()


class OnlinePipeline(Sequential):
    """Scalers, then a learner.

    A row is learned as scaled by the rows up to and including it, and is
    predicted as scaled by the rows before it: statistics move first.
    """

    def __init__(self, *steps: Scaler | Sequential):
        if not steps:
            raise ValueError("a pipeline needs a component")
        if not isinstance(steps[-1], Sequential) or not all(isinstance(s, Scaler) for s in steps[:-1]):
            raise ValueError("a pipeline is scalers, then a learner")
        self.scalers, self.learner = list(steps[:-1]), steps[-1]
        self.supervised = self.learner.supervised
        self.output_ddl = self.learner.output_ddl
        kinds = [f"scaler_{i} {_SCALER_DDL[type(s).__name__]}" for i, s in enumerate(self.scalers)]
        self.state_ddl = ", ".join(["n bigint", *kinds, f"learner {struct_ddl(self.learner.state_ddl)}"])

    @property
    def components(self) -> list:
        return [*self.scalers, self.learner]

    @property
    def n_components(self) -> int:
        return len(self.components)

    def initial(self):
        return {"n": 0, "scalers": None, "learner": self.learner.initial()}

    def _scalers(self, state, d):
        if state["scalers"] is None:
            state["scalers"] = [s.start(d) for s in self.scalers]
        return list(zip(self.scalers, state["scalers"], strict=True))

    def run(self, state, x, y, emit):
        asked = x
        for op, held in self._scalers(state, x.shape[1]):
            asked, x = op.both(held, x, asked)
        state["n"] += len(x)
        if not emit:
            return self.learner.run(state["learner"], x, y, False)
        if self.scalers:
            return self.learner.run_asked(state["learner"], x, y, asked)
        return self.learner.run(state["learner"], x, y, True)

    def apply(self, state, x):
        for op, held in self._scalers(state, x.shape[1]):
            x = op.current(held, x)
        return self.learner.apply(state["learner"], x)

    def dump(self, state):
        held = state["scalers"] or [s.start(0) for s in self.scalers]
        return {"n": state["n"], **{f"scaler_{i}": s for i, s in enumerate(held)}, "learner": self.learner.dump(state["learner"])}

    def load(self, row):
        return {"n": row["n"], "scalers": [dict(row[f"scaler_{i}"]) for i in range(len(self.scalers))], "learner": self.learner.load(row["learner"])}


@dataclass(frozen=True)
class Steps:
    """Scalers that wait for a learner: ``StandardScaler() >> MinMaxScaler() >> Perceptron()``."""

    scalers: tuple[Scaler, ...]

    def __rshift__(self, step: Scaler | Sequential) -> Steps | OnlinePipeline:
        return OnlinePipeline(*self.scalers, step) if isinstance(step, Sequential) else Steps((*self.scalers, step))


class DriftRetrainingWrapper(Sequential):
    """A learner that starts anew when a detector of its own errors reports a drift.

    For each row: predict, learn, pass the error of the prediction to the
    detector, reset the learner on a drift (or, with ``reset_on_warning``, on a
    warning). With ``reset_first`` the detector is asked before the row is
    learned, both are reset on a drift, and the row is then learned afresh.
    """

    output_ddl = "y_pred int, error int, status int"

    def __init__(self, learner: Sequential, detector: Detector, reset_on_warning: bool = False, reset_first: bool = False):
        self.learner, self.detector, self.reset_on_warning, self.reset_first = learner, detector, reset_on_warning, reset_first
        self.state_ddl = f"n bigint, drift_count bigint, warning_count bigint, learner {struct_ddl(learner.state_ddl)}, detector {struct_ddl(detector.state_ddl)}"

    def initial(self):
        return {"n": 0, "drift_count": 0, "warning_count": 0, "learner": self.learner.initial(), "detector": self.detector.initial()}

    def run(self, state, x, y, emit):
        out = {"y_pred": [], "error": [], "status": []}
        for row, label in zip(x, y.tolist(), strict=True):
            predicted = int(self.learner.apply(state["learner"], row[None, :])["y_pred"][0])
            error = int(predicted != label)
            if not self.reset_first:
                self.learner.one(state["learner"], row, label)
            status = self.detector.update(state["detector"], float(error))
            state["n"] += 1
            state["drift_count"] += status == DRIFT
            state["warning_count"] += status == WARNING
            if status == DRIFT or (status == WARNING and self.reset_on_warning):
                state["learner"] = self.learner.initial()
                if self.reset_first:
                    state["detector"] = self.detector.initial()
            if self.reset_first:
                self.learner.one(state["learner"], row, label)
            if emit:
                out["y_pred"].append(predicted)
                out["error"].append(error)
                out["status"].append(status)
        return out

    def apply(self, state, x):
        predicted = self.learner.apply(state["learner"], x)["y_pred"]
        return {"y_pred": predicted, "error": [None] * len(x), "status": [None] * len(x)}

    def dump(self, state):
        return {**state, "learner": self.learner.dump(state["learner"]), "detector": self.detector.dump(state["detector"])}

    def load(self, row):
        return {**row, "learner": self.learner.load(row["learner"]), "detector": self.detector.load(row["detector"])}


# -- column-wise composition


@dataclass
class _Part:
    name: str
    op: Scaler
    features: tuple[str, ...]


class ColumnTransformer:
    """Transforms chosen columns by chosen scalers and puts the results side by side in one ``array<double>``.

    ``parts``: (name, scaler, columns), where columns are names or ``"all"``.
    """

    def __init__(self, parts: Sequence[tuple[str, Scaler, Names]]):
        self.parts = list(parts)

    def _chosen(self, df: DataFrame, features: Sequence[str]) -> list[_Part]:
        out = []
        for name, op, columns in self.parts:
            chosen = tuple(features) if columns == "all" else (columns,) if isinstance(columns, str) else tuple(columns)
            missing = [c for c in chosen if c not in df.columns]
            if missing:
                raise ValueError(f"no such columns: {missing}")
            out.append(_Part(name, op, chosen))
        return out

    def fit(self, df: DataFrame, features: Names = None, key: Names = None) -> FittedColumns:
        names = [features] if isinstance(features, str) else list(features or df.columns)
        return FittedColumns([(part.name, part.op.fit(df, part.features, key)) for part in self._chosen(df, names)])

    def fit_transform(self, df: DataFrame, features: Names, order_by: Names, key: Names = None, name: str = "features") -> DataFrame:
        """All columns of ``df`` and ``name``, by the rows up to each."""
        names, out, made = [features] if isinstance(features, str) else list(features), df, []
        for i, part in enumerate(self._chosen(df, names)):
            out = part.op.prefix(out, part.features, order_by, key, True, f"__c{i}")
            made += [f"{f}__c{i}" for f in part.features]
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*[F.col(f"`{m}`") for m in made]).alias(name))


class FeatureUnion(ColumnTransformer):
    """Several scalers of the same columns, side by side."""

    def __add__(self, other: Scaler) -> FeatureUnion:
        return FeatureUnion(*[op for _, op, _ in self.parts], other)

    def __init__(self, *ops: Scaler):
        super().__init__([(f"{type(op).__name__}_{i}", op, "all") for i, op in enumerate(ops)])


@dataclass
class FittedColumns:
    parts: list[tuple[str, FittedScaler]]

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        out, made = df, []
        for i, (_, part) in enumerate(self.parts):
            out = part.transform(out, f"__c{i}")
            made += [f"{f}__c{i}" for f in part.layout.features]
        values: list[Column] = [F.col(f"`{m}`") for m in made]
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*values).alias(name))


__all__ = ["ColumnTransformer", "DriftRetrainingWrapper", "FeatureUnion", "FittedColumns", "OnlinePipeline", "Steps", "struct_ddl"]
