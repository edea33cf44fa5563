"""What sequential operators have in common: fit, predict, prequential runs, updates, streams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.expressions import vector
from ebbflow.plans import fold as folds
from ebbflow.plans.layout import Layout, Names
from ebbflow.plans.ops import PyOps


class Sequential:
    """An operator whose state depends on the order of rows.

    Subclasses give ``state_ddl``, ``output_ddl`` (what a test-then-train run
    emits for each row), ``initial``, ``run``, ``dump`` and ``load``, and
    ``apply`` if they predict.
    """

    state_ddl = ""
    output_ddl = ""
    #: Whether a target is needed.
    supervised = True
    #: Whether keys are mostly few and large, so that counting them first pays; see :mod:`ebbflow.plans.placement`.
    few_keys = False
    #: Rows of a key that ``run`` gets at a time, where sums over them round; 0: as they come.
    chunk = 0

    def initial(self) -> Any:
        raise NotImplementedError

    def run(self, state: Any, x: np.ndarray, y: np.ndarray, emit: bool) -> dict[str, Any]:
        raise NotImplementedError

    def apply(self, state: Any, x: np.ndarray) -> dict[str, Any]:
        raise NotImplementedError(f"{type(self).__name__} does not predict")

    def dump(self, state: Any) -> dict:
        return state

    def load(self, row: dict) -> Any:
        return row

    def one(self, state: Any, x: np.ndarray, y: float) -> None:
        """Learns a single row."""
        self.run(state, x[None, :], np.array([y]), False)

    def seen(self, state: Any) -> int:
        return state["n"]

    def run_asked(self, state: Any, x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> dict[str, Any]:
        """A test-then-train run in which row i is asked as ``asked[i]`` and learned as ``x[i]``."""
        out: dict[str, list] = {f.name: [] for f in folds.struct_of(self.output_ddl).fields}
        for i in range(len(x)):
            for name, values in self.apply(state, asked[i : i + 1]).items():
                out[name].append(values[0])
            self.one(state, x[i], y[i])
        return out

    # -- on data frames

    def layout(self, df: DataFrame, features: Names, target: str | None, order_by: Names, key: Names, exclude: Names = None) -> Layout:
        if self.supervised and target is None:
            raise ValueError(f"{type(self).__name__} needs a target")
        return Layout.of(df, features, target if self.supervised else None, order_by, key, exclude=exclude)

    def fit(self, df: DataFrame, features: Names = None, target: str | None = None, order_by: Names = None, key: Names = None, *, exclude: Names = None, state: DataFrame | None = None) -> Fitted:
        """Learns all rows of ``df`` in order, one model for each ``key`` value; from ``state``, if given."""
        at = self.layout(df, features, target, order_by, key, exclude)
        return Fitted(self, at, folds.fold(df, self, at, "fit", state))

    def prequential(self, df: DataFrame, features: Names = None, target: str | None = None, order_by: Names = None, key: Names = None, *, exclude: Names = None, state: DataFrame | None = None, keep: Names = None) -> DataFrame:
        """All columns of ``df``, or those in ``keep``, and, for each row, what the operator said of it before it learned it."""
        at = self.layout(df, features, target, order_by, key, exclude)
        return folds.fold(df, self, at, "run", state, keep=keep)

    def stream(self, df: DataFrame, features: Names, target: str | None, order_by: Names, key: Names) -> DataFrame:
        """The prequential run over a streaming frame; see :mod:`ebbflow.streaming`."""
        from ebbflow.streaming.runner import run_stream

        return run_stream(df, self, self.layout(df, features, target, order_by, key))


@dataclass
class Fitted:
    """A learned state: an ordinary table with one row for each key."""

    op: Sequential
    layout: Layout
    state: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and the operator's outputs for each row. Rows with a null feature have nulls."""
        if self.layout.key:
            from dataclasses import replace

            at = replace(self.layout, target=None, order_by=())
            return folds.fold(df, self.op, at, "apply", self.state)
        return apply_global(df, self.op, self.layout.features, self.state)

    def update(self, df: DataFrame) -> Fitted:
        """Learns more rows, which come after all earlier ones."""
        return Fitted(self.op, self.layout, folds.fold(df, self.op, self.layout, "fit", self.state))

    def nobs(self) -> DataFrame:
        return self.state.select(*[F.col(f"`{k}`") for k in self.layout.key], F.col("n").alias("nobs"))

    def reset(self) -> Fitted:
        """The same operator, with nothing learned."""
        return Fitted(self.op, self.layout, self.state.limit(0))


def apply_global(df: DataFrame, op: Sequential, features: Iterable[str], state: DataFrame | None) -> DataFrame:
    """Predictions of a single model: its one state row (``op.initial()`` if there is none) goes to the tasks; no shuffle."""
    rows = state.limit(1).collect() if state is not None else []
    learned = rows[0].asDict(recursive=True) if rows else None
    names, d = list(df.columns), len(tuple(features))
    outputs = folds.struct_of(op.output_ddl)
    data = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), vector([F.col(f"`{f}`") for f in features]).alias("__x"))
    schema = T.StructType([T.StructField("__row", data.schema["__row"].dataType), *outputs.fields])
    types = [folds.to_arrow_type(f.dataType) for f in outputs.fields]

    def work(batches):
        held = op.initial() if learned is None else op.load(learned)
        for batch in batches:
            x = folds.matrix(batch.column(1), d)
            valid = ~np.isnan(x).any(axis=1)
            found = op.apply(held, x[valid])
            arrays = [batch.column(0)]
            for f, t in zip(outputs.fields, types, strict=True):
                values = folds._full(found[f.name], valid)
                arrays.append(pa.array(values, t, from_pandas=True) if isinstance(values, np.ndarray) else pa.array(values, t))
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return data.mapInArrow(work, schema).select("__row.*", *outputs.fieldNames())


class Stepped(Sequential):
    """A sequential operator with one written step for all back-ends.

    ``fields(d)`` gives state names with type and initial value; ``step`` maps
    ``(ops, state, x, y)`` to the new state, and ``answer`` maps ``(ops, state,
    x)`` to the outputs before the step, by name.
    """

    def fields(self, d: int) -> dict[str, tuple[str, Any]]:
        raise NotImplementedError

    def step(self, ops, state, x, y):
        raise NotImplementedError

    def answer(self, ops, state, x) -> dict:
        return {}

    @property
    def state_ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, (kind, _) in self.fields(0).items())

    def initial(self):
        return {"__new": True}

    def _ready(self, state, d: int) -> None:
        if state.pop("__new", False):
            state.update({k: list(v) if isinstance(v, list) else v for k, (_, v) in self.fields(d).items()})

    def run(self, state, x, y, emit):
        self._ready(state, x.shape[1])
        out: dict[str, list] = {f.name: [] for f in folds.struct_of(self.output_ddl).fields} if emit else {}
        for row, label in zip(x.tolist(), y.tolist(), strict=True):
            if emit:
                for name, value in self.answer(PyOps, state, row).items():
                    out[name].append(value)
            state.update(self.step(PyOps, state, row, label))
            if emit:
                for name, value in self.after(state).items():
                    out[name].append(value)
        return out

    def one(self, state, x, y):
        self._ready(state, len(x))
        state.update(self.step(PyOps, state, x.tolist(), y))

    def after(self, state) -> dict:
        """Outputs that are known only after the step."""
        return {}

    def apply(self, state, x):
        self._ready(state, x.shape[1])
        out: dict[str, list] = {f.name: [] for f in folds.struct_of(self.output_ddl).fields}
        for row in x.tolist():
            for name, value in self.answer(PyOps, state, row).items():
                out[name].append(value)
        return out

    def dump(self, state):
        if "__new" in state:
            return {k: v for k, (_, v) in self.fields(0).items()}
        return state

    def load(self, row):
        return dict(row)

    def fit_native(self, df: DataFrame, features: Names = None, target: str | None = None, order_by: Names = None, key: Names = None, *, exclude: Names = None) -> Fitted:
        """``fit`` inside the JVM, for keys of bounded size; see :func:`ebbflow.plans.fold.native_fold`."""
        at = self.layout(df, features, target, order_by, key, exclude)
        return Fitted(self, at, folds.native_fold(df, self, at))
