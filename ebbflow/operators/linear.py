"""Linear models.

``Regression`` is mergeable: its state is sums, built by partial aggregation.
The classifiers are strictly sequential and never merged by averaging.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.expressions import dot, vector
from ebbflow.functions.optimizers import Adam, Rule
from ebbflow.operators.base import Fitted, Sequential, Stepped
from ebbflow.plans.layout import Layout, Names, masked, names
from ebbflow.plans.windows import prefix

# -- ordinary least squares


def _solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray | None:
    """Coefficients, or None if the system has no unique solution."""
    if np.linalg.matrix_rank(gram) < len(gram):
        return None
    return np.linalg.solve(gram, moment)


def _coefficients(rows: DataFrame, d: int) -> DataFrame:
    """The fields of ``row`` and ``coef``: intercept first, null where the system is singular. ``rows`` has ``row, n, sx, sy, sxx, sxy``."""
    schema = T.StructType([rows.schema["row"], T.StructField("coef", T.ArrayType(T.DoubleType()))])
    upper = np.triu_indices(d)

    def work(batches):
        for batch in batches:
            out = []
            for n, sx, sy, sxx, sxy in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if not n:
                    out.append(None)
                    continue
                gram = np.zeros((d + 1, d + 1))
                gram[0, 0], gram[0, 1:], gram[1:, 0] = n, sx, sx
                inner = np.zeros((d, d))
                inner[upper] = sxx
                gram[1:, 1:] = inner + np.triu(inner, 1).T
                solved = _solve(gram, np.array([sy, *sxy]))
                out.append(None if solved is None else solved.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["row", "coef"])

    return rows.mapInArrow(work, schema).select("row.*", "coef")


def _products(features: tuple[str, ...], target: str) -> tuple[Column, dict[str, Column]]:
    """Which rows take part (those without nulls), and what is summed, by name."""
    x = [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{target}`").cast("double")
    known = y.isNotNull() & ~F.isnan(y)
    for v in x:
        known = known & v.isNotNull() & ~F.isnan(v)
    parts = {"n": F.lit(1), "sy": y}
    parts |= {f"sx{i}": v for i, v in enumerate(x)}
    parts |= {f"sxy{i}": v * y for i, v in enumerate(x)}
    parts |= {f"sxx{i}_{j}": x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))}
    return known, parts


def _packed(d: int, mark: str = "") -> list[Column]:
    """``n, sx, sy, sxx, sxy`` from single sums, whose names begin with ``mark``."""
    zero = lambda c: f"coalesce({mark}{c}, 0D)"
    listed = lambda names: f"array({', '.join(map(zero, names))})"
    packed = {
        "n": f"cast({mark}n AS bigint)", "sx": listed(f"sx{i}" for i in range(d)), "sy": zero("sy"),
        "sxx": listed(f"sxx{i}_{j}" for i in range(d) for j in range(i, d)), "sxy": listed(f"sxy{i}" for i in range(d)),
    }
    return [F.expr(f"{value} AS {name}") for name, value in packed.items()]


class Regression:
    """Ordinary least squares with an intercept, by sufficient statistics.

    The state ``n, sx, sy, sxx, sxy`` (``sxx``: upper triangle by rows) is a sum
    over rows, so states of disjoint rows merge by addition.
    """

    def fit(self, df: DataFrame, features: Names = None, target: str | None = None, key: Names = None, *, exclude: Names = None) -> FittedRegression:
        if target is None:
            raise ValueError("Regression needs a target")
        at = Layout.of(df, features, target, None, key, ordered=False, exclude=exclude)
        d = len(at.features)
        rows = masked(df, at.key, [F.col(f"`{c}`") for c in (*at.features, target)])
        sums = {"n": f"count(__v{d})", "sy": f"sum(__v{d})"} | {f"sx{i}": f"sum(__v{i})" for i in range(d)} | {f"sxy{i}": f"sum(__v{i} * __v{d})" for i in range(d)}
        sums |= {f"sxx{i}_{j}": f"sum(__v{i} * __v{j})" for i in range(d) for j in range(i, d)}
        summed = rows.groupBy(*[f"__k{i}" for i in range(len(at.key))]).agg(*[F.expr(f"{value} AS __{name}") for name, value in sums.items()])
        if at.key:
            summed = summed.where("__n > 0")
        return FittedRegression(at, summed.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(at.key)], *_packed(d, "__")))

    def prefix(self, df: DataFrame, features: Names, target: str, order_by: Names, key: Names = None, inclusive: bool = False) -> DataFrame:
        """All columns of ``df``, ``y_pred`` and ``coef`` from the rows before each (and the row itself, if ``inclusive``).

        Without a solution ``coef`` is null and ``y_pred`` 0.
        """
        at = Layout.of(df, features, target, order_by, key)
        known, parts = _products(at.features, target)
        run = prefix(df, {f"__{name}": ("count" if name == "n" else "sum", F.when(known, value)) for name, value in parts.items()}, at.order_by, at.key, inclusive)
        d = len(at.features)
        solved = _coefficients(run.select(_row(df.columns), *_packed(d, "__")), d)
        return solved.select("*", _predicted(at.features).alias("y_pred"))


def _row(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def _predicted(features: tuple[str, ...]) -> Column:
    coef = F.col("coef")
    return F.when(coef.isNull(), 0.0).otherwise(F.get(coef, F.lit(0)) + dot(F.slice(coef, 2, len(features)), vector([F.col(f"`{f}`") for f in features])))


@dataclass
class FittedRegression:
    layout: Layout
    state: DataFrame

    def merge(self, other: FittedRegression) -> FittedRegression:
        """The model of both models' rows."""
        d = len(self.layout.features)
        both = self.state.unionByName(other.state)
        added = lambda c, size: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)]).alias(c)
        keys = [F.col(f"`{k}`") for k in self.layout.key]
        summed = both.groupBy(*keys).agg(F.sum("n").alias("n"), added("sx", d), F.sum("sy").alias("sy"), added("sxx", d * (d + 1) // 2), added("sxy", d))
        return FittedRegression(self.layout, summed)

    def update(self, df: DataFrame) -> FittedRegression:
        return self.merge(Regression().fit(df, self.layout.features, self.layout.target, self.layout.key))

    def coefficients(self) -> DataFrame:
        """Key columns, ``n`` and ``coef`` (intercept first; null if singular)."""
        return _coefficients(self.state.select(_row([*self.layout.key, "n"]), "n", "sx", "sy", "sxx", "sxy"), len(self.layout.features))

    coef = weights = coefficients

    def intercept(self) -> DataFrame:
        return self.coefficients().select(*[F.col(f"`{k}`") for k in self.layout.key], F.get("coef", F.lit(0)).alias("intercept"))

    def predict(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and ``y_pred``; 0 from an empty or singular model."""
        return with_state(df, self.coefficients().drop("n"), self.layout.key).select(*[F.col(f"`{c}`") for c in df.columns], _predicted(self.layout.features).alias("y_pred"))


def with_state(df: DataFrame, state: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns of the state of its key; nulls where there is none.

    Without keys the state is one row, which is broadcast; with keys Spark
    chooses, by size.
    """
    if not key:
        return df.join(F.broadcast(state.limit(1)), F.lit(True), "left")
    renamed = state.select(*[F.col(f"`{k}`").alias(f"__of_{i}") for i, k in enumerate(key)], *[F.col(f"`{c}`") for c in state.columns if c not in key])
    on = None
    for i, k in enumerate(key):
        same = df[f"`{k}`"].eqNullSafe(renamed[f"__of_{i}"])
        on = same if on is None else on & same
    return df.join(renamed, on, "left").drop(*[f"__of_{i}" for i in range(len(key))])


# -- sequential classifiers

_BINARY = "y_pred int, proba double"


class _Binary(Stepped):
    """Two classes told apart by the sign of ``w . x + b``; ``w`` holds the bias last."""

    output_ddl = _BINARY

    def fields(self, d):
        return {"w": ("array<double>", [0.0] * d), "b": ("double", 0.0), "n": ("bigint", 0)}

    def answer(self, ops, state, x):
        """``proba``: of class 1."""
        if not state["n"]:
            return {"y_pred": 0, "proba": 0.5}
        z = ops.dot(state["w"], x) + state["b"]
        return {"y_pred": int(z >= 0), "proba": self._probability(z)}

    def _probability(self, z):
        return 1.0 if z >= 0 else 0.0

    def apply(self, state, x):
        self._ready(state, x.shape[1])
        if not state["n"]:
            return {"y_pred": np.zeros(len(x), dtype=np.int64), "proba": np.full(len(x), 0.5)}
        z = x @ np.array(state["w"]) + state["b"]
        return {"y_pred": (z >= 0).astype(np.int64), "proba": np.array([self._probability(v) for v in z.tolist()])}


class Perceptron(_Binary):
    """Labels by sign (0 or less: negative); moves only on mistakes."""

    def __init__(self, eta: float = 1.0):
        self.eta = eta

    def step(self, ops, state, x, y):
        label = ops.where(y <= 0, lambda: -1.0, lambda: 1.0)

        def moved(v):
            z, t = v["z"], v["t"]
            rate = ops.where(ops.both(z >= 0, t < 0), lambda: -self.eta, lambda: ops.where(ops.both(z < 0, t > 0), lambda: self.eta, lambda: 0.0))
            return ops.let({"r": rate}, lambda u: {"w": ops.each(lambda w, f: w + u["r"] * f, state["w"], x), "b": state["b"] + u["r"], "n": state["n"] + 1})

        return ops.let({"z": ops.dot(state["w"], x) + state["b"], "t": label}, moved)

    def run(self, state, x, y, emit):
        """The same steps in one plain loop: products are summed in the same order."""
        self._ready(state, x.shape[1])
        w, b, eta = list(state["w"]), state["b"], self.eta
        predicted = np.zeros(len(x), dtype=np.int64)
        for i, (row, label) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            if sum(map(mul, w, row)) + b >= 0:
                predicted[i] = 1
                if label <= 0:
                    w = [v - eta * f for v, f in zip(w, row)]  # noqa: B905
                    b -= eta
            elif label > 0:
                w = [v + eta * f for v, f in zip(w, row)]  # noqa: B905
                b += eta
        before = state["n"]
        state["w"], state["b"], state["n"] = w, float(b), before + len(x)
        if not emit:
            return {}
        proba = predicted.astype(np.float64)
        if not before and len(x):
            predicted[0], proba[0] = 0, 0.5
        return {"y_pred": predicted, "proba": proba}


class PassiveAggressive(_Binary):
    """Margin updates no larger than needed: ``pa1`` caps the step at ``c``, ``pa2`` softens it."""

    def __init__(self, c: float = 1.0, mode: str = "pa1"):
        if mode not in ("pa1", "pa2"):
            raise ValueError("mode must be pa1 or pa2")
        self.c, self.mode = c, mode

    def step(self, ops, state, x, y):
        label = ops.where(y <= 0, lambda: -1.0, lambda: 1.0)

        def moved(v):
            loss, size, t = v["loss"], v["size"], v["t"]
            tau = ops.least(self.c, loss / size) if self.mode == "pa1" else loss / (size + 1 / (2 * self.c))
            return ops.let({"r": tau * t}, lambda u: {"w": ops.each(lambda w, f: w + u["r"] * f, state["w"], x), "b": state["b"] + u["r"], "n": state["n"] + 1})

        def judged(v):
            return ops.let({"loss": ops.greatest(0.0, 1.0 - v["t"] * v["z"]), "size": ops.dot(x, x) + 1.0, "t": v["t"]}, moved)

        return ops.let({"z": ops.dot(state["w"], x) + state["b"], "t": label}, judged)


class LogisticRegression(_Binary):
    """Logistic loss by a stochastic update rule, with L1 and L2 terms on the weights and none on the bias.

    The bias follows the same rule as the weights. State: weights, bias, ``n``
    and, for each slot of the rule, an array with the bias's value last.
    """

    def __init__(self, optimizer: Rule | None = None, l1: float = 0.0, l2: float = 0.0):
        self.optimizer, self.l1, self.l2 = optimizer or Adam(0.01), l1, l2

    def fields(self, d):
        slots = {f"slot_{name}": ("array<double>", [value] * (d + 1)) for name, value in self.optimizer.slots.items()}
        return {**super().fields(d), **slots}

    def _probability(self, z):
        return 1.0 / (1.0 + float(np.exp(-z))) if z > -700 else 0.0

    def step(self, ops, state, x, y):
        rule, slots = self.optimizer, list(self.optimizer.slots)
        label = ops.where(y <= 0, lambda: 0.0, lambda: 1.0)
        d = None if not isinstance(x, list) else len(x)
        t = state["n"] + 1

        def gradient(v):
            e = v["e"]

            def of(w, f):
                g = e * f
                if self.l1:
                    g = g + self.l1 * ops.sign(w)
                if self.l2:
                    g = g + self.l2 * w
                return g

            return ops.let({"g": ops.each(of, state["w"], x), "e": e}, update)

        def update(v):
            if d is not None:
                every, grads = [*state["w"], state["b"]], [*v["g"], v["e"]]
            else:
                every, grads = F.concat(state["w"], F.array(state["b"])), F.concat(v["g"], F.array(v["e"]))

            def move(g, w, *s):
                taken, new = rule.move(ops, g, w, dict(zip(slots, s, strict=True)), t)
                return {"w": w - taken, **{name: new[name] for name in slots}}

            moved = ops.each(move, grads, every, *[state[f"slot_{name}"] for name in slots])
            return ops.let({"p": moved}, gathered)

        def gathered(v):
            p = v["p"]
            if d is not None:
                out = {"w": [q["w"] for q in p[:d]], "b": p[d]["w"], "n": t}
                return out | {f"slot_{name}": [q[name] for q in p] for name in slots}
            out = {"w": F.slice(p["w"], 1, F.size(p) - 1), "b": F.element_at(p["w"], -1), "n": t}
            return out | {f"slot_{name}": p[name] for name in slots}

        return ops.let({"e": ops.sigmoid(ops.dot(state["w"], x) + state["b"]) - label}, gradient)

    def run(self, state, x, y, emit):
        """The same steps; Adam without L1 and L2, the default, has its own loop."""
        if type(self.optimizer) is not Adam or self.l1 or self.l2:
            return Stepped.run(self, state, x, y, emit)
        self._ready(state, x.shape[1])
        d, n, rule, z_out = x.shape[1], state["n"], self.optimizer, np.zeros(len(x))
        adam = self._adam_lists if d <= 32 else self._adam_arrays
        w, m, v = adam([*state["w"], state["b"]], state["slot_m"], state["slot_v"], x, (y > 0).astype(np.float64).tolist(), rule, n, z_out)
        state.update(w=w[:d], b=w[d], n=n + len(x), slot_m=m, slot_v=v)
        if not emit:
            return {}
        predicted, proba = (z_out >= 0).astype(np.int64), 1 / (1 + np.exp(-z_out))
        if not n and len(x):
            predicted[0], proba[0] = 0, 0.5
        return {"y_pred": predicted, "proba": proba}

    @staticmethod
    def _adam_lists(w, m, v, x, labels, rule, n, z_out):
        b1, b2, eta = rule.beta1, rule.beta2, rule.eta
        p1, p2, exp, sqrt = b1**n, b2**n, math.exp, math.sqrt
        for i, (row, label) in enumerate(zip(x.tolist(), labels, strict=True)):
            row.append(1.0)
            z = sum(map(mul, w, row))
            z_out[i] = z
            e = (1.0 / (1.0 + exp(-z)) if z > -700 else 0.0) - label
            p1 *= b1
            p2 *= b2
            first, second, unbias, rate = (1 - b1) * e, (1 - b2) * e * e, 1 / (1 - p2), eta / (1 - p1)
            m = [b1 * a + first * f for a, f in zip(m, row)]  # noqa: B905
            v = [b2 * a + second * f * f for a, f in zip(v, row)]  # noqa: B905
            w = [a - rate * p / (sqrt(q * unbias) + 1e-8) for a, p, q in zip(w, m, v)]  # noqa: B905
        return w, m, v

    @staticmethod
    def _adam_arrays(w, m, v, x, labels, rule, n, z_out):
        b1, b2, eta = rule.beta1, rule.beta2, rule.eta
        w, m, v, p1, p2 = np.array(w), np.array(m), np.array(v), b1**n, b2**n
        rows = np.concatenate((x, np.ones((len(x), 1))), axis=1)
        for i, label in enumerate(labels):
            row = rows[i]
            z = float(row.dot(w))
            z_out[i] = z
            g = row * ((1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0) - label)
            p1 *= b1
            p2 *= b2
            m = b1 * m + (1 - b1) * g
            v = b2 * v + (1 - b2) * g * g
            w = w - eta / (1 - p1) * m / (np.sqrt(v / (1 - p2)) + 1e-8)
        return w.tolist(), m.tolist(), v.tolist()


def proba_map(proba: str = "proba") -> Column:
    """``map<int, double>`` of a binary classifier."""
    return F.create_map(F.lit(0), 1 - F.col(proba), F.lit(1), F.col(proba))


__all__ = ["Fitted", "FittedRegression", "LogisticRegression", "PassiveAggressive", "Perceptron", "Regression", "Sequential", "names", "proba_map", "with_state"]
