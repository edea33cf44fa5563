"""Scalers, encoders and imputers: mergeable statistics and pure projections.

Each has a batch form (``fit`` then ``transform``) and a running form
(``prefix``), where each row is transformed by the statistics of the rows up to
it, or before it. Nulls are skipped in statistics and stay null in transforms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.linear import with_state
from ebbflow.plans.layout import Layout, Names, names
from ebbflow.plans.windows import order_blocks, prefix, row_numbers

Stat = Callable[[str], Column]


def _quoted(of: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{c}`") for c in of]


class Scaler:
    """``stats`` are kept for each feature; ``scaled`` and ``restored`` are written against them."""

    stats: tuple[str, ...] = ()
    invertible = True

    def aggregates(self, x: Column) -> dict[str, Column]:
        raise NotImplementedError

    def merged(self, at: Callable[[str], Column]) -> dict[str, Column]:
        """Aggregates over states; ``at(name)`` is the statistic of one state."""
        raise NotImplementedError

    def running(self, x: Column) -> dict[str, tuple[str, Column]]:
        """Running sums from which ``from_running`` makes the statistics."""
        raise NotImplementedError

    def from_running(self, at: Callable[[str], Column]) -> dict[str, Column]:
        raise NotImplementedError

    def scaled(self, x: Column, s: Stat) -> Column:
        raise NotImplementedError

    def restored(self, x: Column, s: Stat) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def pivot(self, df: DataFrame, features: tuple[str, ...]) -> list[float]:
        return [0.0] * len(features)

    def __rshift__(self, step):
        """This scaler, then another or a learner."""
        from ebbflow.operators.compose import Steps

        return Steps((self,)) >> step

    def __add__(self, other: Scaler):
        """The outputs of both, side by side."""
        from ebbflow.operators.compose import FeatureUnion

        return FeatureUnion(self, other)

    def fit(self, df: DataFrame, features: Names = None, key: Names = None, *, exclude: Names = None) -> FittedScaler:
        at = Layout.of(df, features, None, None, key, ordered=False, exclude=exclude)
        columns = [F.col(f"`{f}`").cast("double") for f in at.features]
        values = [self.aggregates(F.when(~F.isnan(x), x)) for x in columns]
        state = df.groupBy(*_quoted(at.key)).agg(F.count("*").alias("n"), *[F.array(*[v[s] for v in values]).alias(s) for s in self.stats])
        return FittedScaler(self, at, state)

    def fit_transform(self, df: DataFrame, features: Names = None, order_by: Names = None, key: Names = None, suffix: str = "") -> DataFrame:
        """Each row by the statistics that include it."""
        return self.prefix(df, features, order_by, key, True, suffix)

    def prefix(self, df: DataFrame, features: Names = None, order_by: Names = None, key: Names = None, inclusive: bool = True, suffix: str = "") -> DataFrame:
        at = Layout.of(df, features, None, order_by, key)
        pivots = self.pivot(df, at.features)
        sums: dict[str, tuple[str, Column]] = {}
        for i, f in enumerate(at.features):
            x = F.col(f"`{f}`").cast("double") - pivots[i]
            sums |= {f"__s{i}_{name}": v for name, v in self.running(F.when(~F.isnan(x), x)).items()}
        run = prefix(df, sums, at.order_by, at.key, inclusive)
        made = []
        for i, f in enumerate(at.features):
            stats = self.from_running(lambda name, i=i: F.col(f"__s{i}_{name}"))
            shifted = {k: v + pivots[i] if k == "mean" else v for k, v in stats.items()}
            made.append(self.scaled(F.col(f"`{f}`").cast("double"), lambda name, s=shifted: s[name]).alias(f"{f}{suffix}"))
        keep = [F.col(f"`{c}`") for c in df.columns if suffix or c not in at.features]
        return run.select(*keep, *made)

    # -- inside an ordered fold

    def start(self, d: int) -> dict:
        raise NotImplementedError

    def steps(self, state: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics before the first and after each row of a block; learns the block."""
        raise NotImplementedError

    def scale(self, v: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def both(self, state: dict, x: np.ndarray, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Learns ``x``; returns ``asked`` (``x`` itself) by the rows before each and ``x`` by the rows up to each."""
        s = self.steps(state, x)
        before, after = {k: v[:-1] for k, v in s.items()}, {k: v[1:] for k, v in s.items()}
        return self.scale(x if asked is None else asked, before), self.scale(x, after)

    def current(self, state: dict, x: np.ndarray) -> np.ndarray:
        """``x`` by what was learned, without learning."""
        return self.scale(x, self.steps(dict(state), x[:0]))


@dataclass
class FittedScaler:
    op: Scaler
    layout: Layout
    state: DataFrame

    def _mapped(self, df: DataFrame, use, suffix: str) -> DataFrame:
        held = self.state.select(*_quoted(self.layout.key), F.struct("n", *self.op.stats).alias("__stats"))
        met = with_state(df, held, self.layout.key)
        made = [use(F.col(f"`{f}`").cast("double"), lambda name, i=i: F.col("__stats.n") if name == "n" else F.get(F.col(f"__stats.{name}"), F.lit(i))).alias(f"{f}{suffix}") for i, f in enumerate(self.layout.features)]
        return met.select(*[F.col(f"`{c}`") for c in df.columns if suffix or c not in self.layout.features], *made)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """``df`` with its features scaled, in place or as new columns with ``suffix``."""
        return self._mapped(df, self.op.scaled, suffix)

    def inverse_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return self._mapped(df, self.op.restored, suffix)

    def merge(self, other: FittedScaler) -> FittedScaler:
        d = len(self.layout.features)
        both = self.state.unionByName(other.state)
        merged = [self.op.merged(lambda name, i=i: F.col("n") if name == "n" else F.get(F.col(name), F.lit(i))) for i in range(d)]
        state = both.groupBy(*_quoted(self.layout.key)).agg(F.sum("n").alias("__n"), *[F.array(*[m[s] for m in merged]).alias(s) for s in self.op.stats])
        return FittedScaler(self.op, self.layout, state.withColumnRenamed("__n", "n").select(*_quoted(self.layout.key), "n", *self.op.stats))

    def update(self, df: DataFrame) -> FittedScaler:
        return self.merge(self.op.fit(df, self.layout.features, self.layout.key))


class StandardScaler(Scaler):
    """``(x - mean) / sd`` with the sample standard deviation; 0 where there is no spread. A feature without statistics passes through."""

    stats = ("count", "mean", "m2")

    def aggregates(self, x):
        return {"count": F.count(x).cast("double"), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x)}

    def merged(self, at):
        n, mean = F.sum(at("count")), F.sum(at("count") * at("mean")) / F.sum(at("count"))
        return {"count": n, "mean": mean, "m2": F.sum(at("m2")) + F.greatest(F.sum(at("count") * at("mean") * at("mean")) - n * mean * mean, F.lit(0.0))}

    def running(self, x):
        return {"c": ("count", x), "s": ("sum", x), "q": ("sum", x * x)}

    def from_running(self, at):
        n = at("c")
        safe = F.when(n > 0, n)
        return {"count": n.cast("double"), "mean": at("s") / safe, "m2": F.greatest(at("q") - at("s") * at("s") / safe, F.lit(0.0))}

    def pivot(self, df, features):
        row = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"p{i}") for i, f in enumerate(features)]).first()
        return [float(v) if v is not None and v == v else 0.0 for v in row]

    def _sd(self, s):
        return F.sqrt(s("m2") / F.when(s("count") > 1, s("count") - 1))

    def scaled(self, x, s):
        sd = self._sd(s)
        return F.when(F.coalesce(s("count"), F.lit(0.0)) == 0, x).when(sd > 0, (x - s("mean")) / sd).when(x.isNotNull(), 0.0)

    def restored(self, x, s):
        return F.when(F.coalesce(s("count"), F.lit(0.0)) == 0, x).otherwise(x * F.coalesce(self._sd(s), F.lit(0.0)) + s("mean"))

    def start(self, d):
        return {"n": 0, "mean": [0.0] * d, "m2": [0.0] * d}

    def steps(self, state, x):
        n, mean, m2 = state["n"], np.array(state["mean"]), np.array(state["m2"])
        if not n and len(x):
            mean = x[0].copy()
        gaps = x - mean
        zero = np.zeros((1, len(mean)))
        s = np.concatenate((zero, np.cumsum(gaps, axis=0)))
        q = np.concatenate((zero, np.cumsum(gaps * gaps, axis=0)))
        count = (n + np.arange(len(x) + 1))[:, None].astype(np.float64)
        safe = np.maximum(count, 1)
        means, squares = mean + s / safe, np.maximum(m2 + q - s * s / safe, 0.0)
        state.update(n=n + len(x), mean=means[-1].tolist(), m2=squares[-1].tolist())
        return {"count": count, "mean": means, "sd": np.sqrt(squares / np.maximum(count - 1, 1))}

    def scale(self, v, s):
        known, spread = s["count"] > 0, (s["count"] > 1) & (s["sd"] > 0)
        return np.where(known, np.where(spread, (v - s["mean"]) / np.where(s["sd"] > 0, s["sd"], 1), 0.0), v)


class MinMaxScaler(Scaler):
    """``(x - min) / (max - min)``, not clipped; 0 where there is no range. No inverse."""

    stats = ("low", "high")
    invertible = False

    def aggregates(self, x):
        return {"low": F.min(x), "high": F.max(x)}

    def merged(self, at):
        return {"low": F.min(at("low")), "high": F.max(at("high"))}

    def running(self, x):
        return {"low": ("min", x), "high": ("max", x)}

    def from_running(self, at):
        return {"low": at("low"), "high": at("high")}

    def scaled(self, x, s):
        span = s("high") - s("low")
        return F.when(span.isNull(), x).when(span > 0, (x - s("low")) / F.when(span > 0, span)).when(x.isNotNull(), 0.0)

    def start(self, d):
        return {"n": 0, "low": [float("inf")] * d, "high": [float("-inf")] * d}

    def steps(self, state, x):
        low = np.minimum.accumulate(np.concatenate((np.array([state["low"]]), x)), axis=0)
        high = np.maximum.accumulate(np.concatenate((np.array([state["high"]]), x)), axis=0)
        state.update(n=state["n"] + len(x), low=low[-1].tolist(), high=high[-1].tolist())
        return {"low": low, "high": high}

    def scale(self, v, s):
        known = s["low"] <= s["high"]
        low = np.where(known, s["low"], 0.0)
        span = np.where(known, s["high"], 0.0) - low
        return np.where(known, np.where(span > 0, (v - low) / np.where(span > 0, span, 1), 0.0), v)


class MaxAbsScaler(Scaler):
    """``x / max|x|``; unchanged, both ways, where that is 0."""

    stats = ("top",)

    def aggregates(self, x):
        return {"top": F.max(F.abs(x))}

    def merged(self, at):
        return {"top": F.max(at("top"))}

    def running(self, x):
        return {"top": ("max", F.abs(x))}

    def from_running(self, at):
        return {"top": at("top")}

    def scaled(self, x, s):
        top = s("top")
        return F.when(F.coalesce(top, F.lit(0.0)) > 0, x / F.when(top > 0, top)).otherwise(x)

    def restored(self, x, s):
        return F.when(F.coalesce(s("top"), F.lit(0.0)) > 0, x * s("top")).otherwise(x)

    def start(self, d):
        return {"n": 0, "top": [0.0] * d}

    def steps(self, state, x):
        top = np.maximum.accumulate(np.concatenate((np.array([state["top"]]), np.abs(x))), axis=0)
        state.update(n=state["n"] + len(x), top=top[-1].tolist())
        return {"top": top}

    def scale(self, v, s):
        return np.where(s["top"] > 0, v / np.where(s["top"] > 0, s["top"], 1), v)


# -- encoders


class _FirstSeen:
    """Categories of one column, numbered from 1 in the order in which they were first seen. Null is no category."""

    def fit(self, df: DataFrame, column: str, order_by: Names, key: Names = None) -> FittedEncoder:
        at = Layout.of(df, column, None, order_by, key)
        place = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(at.order_by)])
        seen = df.where(F.col(f"`{column}`").isNotNull()).groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(at.key)], F.col(f"`{column}`").alias("category")).agg(F.min(place).alias("first"))
        flat = seen.select("*", *[F.col(f"first.o{i}").alias(f"o{i}") for i in range(len(at.order_by))])
        ranked = row_numbers(flat, [f"o{i}" for i in range(len(at.order_by))], [f"k{i}" for i in range(len(at.key))], "index")
        state = ranked.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(at.key)], "category", F.col("index").cast("int").alias("index"), "first")
        return FittedEncoder(self, at, state)

    def encoded(self, index: Column, width: Column) -> Column:
        raise NotImplementedError


class OneHotEncoder(_FirstSeen):
    """``array<double>`` with a 1 at the category's place; all zeros for one never seen."""

    def encoded(self, index, width):
        return F.transform(F.sequence(F.lit(1), width), lambda i: F.when(i == index, 1.0).otherwise(0.0))


class OrdinalEncoder(_FirstSeen):
    """The category's place as a double, 0.0 for one never seen."""

    def encoded(self, index, width):
        return F.coalesce(index.cast("double"), F.lit(0.0))


@dataclass
class FittedEncoder:
    op: _FirstSeen
    layout: Layout
    state: DataFrame

    def transform(self, df: DataFrame, name: str | None = None, prefix: bool = False) -> DataFrame:
        """``df`` with the encoded column, in place or as ``name``.

        With ``prefix`` only categories first seen before a row count for it:
        what an encoder that had learned the rows before would say.
        """
        column, keys = self.layout.features[0], self.layout.key
        widths = self.state.groupBy(*_quoted(keys)).agg(F.count("*").cast("int").alias("__width"))
        codes = self.state.select(*[F.col(f"`{k}`").alias(f"__e{i}") for i, k in enumerate(keys)], F.col("category").alias("__category"), F.col("index").alias("__index"), F.col("first").alias("__first"))
        on = F.col(f"`{column}`") == F.col("__category")
        for i, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__e{i}"))
        met = with_state(df.join(codes, on, "left"), widths, keys)
        index = F.col("__index")
        if prefix:
            place = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(self.layout.order_by)])
            index = F.when(F.col("__first") < place, index)
        made = self.op.encoded(index, F.greatest(F.coalesce("__width", F.lit(0)), F.lit(1))).alias(name or column)
        return met.select(*[F.col(f"`{c}`") for c in df.columns if name or c != column], made)


class TargetEncoder:
    """``w * category mean + (1 - w) * overall mean`` with ``w = n / (n + smoothing)``; the overall mean for a category never seen, 0 with no rows."""

    def __init__(self, smoothing: float = 1.0):
        self.smoothing = smoothing

    def _blend(self, n: Column, total: Column, all_n: Column, all_total: Column) -> Column:
        overall = F.coalesce(all_total / F.when(all_n > 0, all_n), F.lit(0.0))
        w = n / (n + self.smoothing)
        return F.when(F.coalesce(n, F.lit(0)) > 0, w * (total / F.when(n > 0, n)) + (1 - w) * overall).otherwise(overall)

    def fit(self, df: DataFrame, column: str, target: str, key: Names = None) -> FittedTargetEncoder:
        at = Layout.of(df, column, target, None, key, ordered=False)
        y = F.col(f"`{target}`").cast("double")
        state = df.where(y.isNotNull()).groupBy(*_quoted(at.key), F.col(f"`{column}`").alias("category")).agg(F.count("*").alias("n"), F.sum(y).alias("total"))
        return FittedTargetEncoder(self, at, state)

    def prefix(self, df: DataFrame, column: str, target: str, order_by: Names, key: Names = None, inclusive: bool = False, name: str = "encoded") -> DataFrame:
        """All columns of ``df`` and the encoding by the rows before each (or up to it)."""
        at = Layout.of(df, column, target, order_by, key)
        y = F.col(f"`{target}`").cast("double")
        blocks = order_blocks(df, at.order_by)
        own = prefix(df, {"__n": ("count", y), "__t": ("sum", y)}, at.order_by, (*at.key, column), inclusive, blocks)
        every = prefix(own, {"__an": ("count", y), "__at": ("sum", y)}, at.order_by, at.key, inclusive, blocks)
        made = self._blend(F.col("__n"), F.col("__t"), F.col("__an"), F.col("__at"))
        return every.select(*[F.col(f"`{c}`") for c in df.columns], made.alias(name))


@dataclass
class FittedTargetEncoder:
    op: TargetEncoder
    layout: Layout
    state: DataFrame

    def transform(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        keys = self.layout.key
        overall = self.state.groupBy(*_quoted(keys)).agg(F.sum("n").alias("__an"), F.sum("total").alias("__at"))
        codes = self.state.select(*[F.col(f"`{k}`").alias(f"__e{i}") for i, k in enumerate(keys)], F.col("category").alias("__category"), F.col("n").alias("__n"), F.col("total").alias("__t"))
        on = F.col(f"`{self.layout.features[0]}`").eqNullSafe(F.col("__category"))
        for i, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__e{i}"))
        met = with_state(df.join(codes, on, "left"), overall, keys)
        return met.select(*[F.col(f"`{c}`") for c in df.columns], self.op._blend(F.col("__n"), F.col("__t"), F.col("__an"), F.col("__at")).alias(name))

    def merge(self, other: FittedTargetEncoder) -> FittedTargetEncoder:
        both = self.state.unionByName(other.state)
        summed = both.groupBy(*_quoted(self.layout.key), F.col("category").alias("__c")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return FittedTargetEncoder(self.op, self.layout, summed.withColumnRenamed("__c", "category"))


# -- imputers


class MeanImputer:
    """Nulls become the mean; 0 before any value."""

    def fit(self, df: DataFrame, column: str, key: Names = None) -> DataFrame:
        """State: key columns, ``n`` (all rows), ``count`` and ``total`` of values."""
        x = F.col(f"`{column}`").cast("double")
        return df.groupBy(*_quoted(names(key))).agg(F.count("*").alias("n"), F.count(x).alias("count"), F.sum(x).alias("total"))

    def transform(self, df: DataFrame, column: str, state: DataFrame, key: Names = None, name: str = "imputed") -> DataFrame:
        held = state.select(*_quoted(names(key)), F.coalesce(F.col("total") / F.when(F.col("count") > 0, F.col("count")), F.lit(0.0)).alias("__mean"))
        met = with_state(df, held, names(key))
        return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(f"`{column}`").cast("double"), F.col("__mean"), F.lit(0.0)).alias(name))

    def prefix(self, df: DataFrame, column: str, order_by: Names, key: Names = None, name: str = "imputed") -> DataFrame:
        """All columns of ``df`` and the value or the mean of the values before it."""
        x = F.col(f"`{column}`").cast("double")
        run = prefix(df, {"__c": ("count", x), "__t": ("sum", x)}, order_by, key)
        return run.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(x, F.col("__t") / F.when(F.col("__c") > 0, F.col("__c")), F.lit(0.0)).alias(name))


class ModeImputer:
    """Nulls become the most frequent value, the first seen of equals; null while there is none."""

    def fit(self, df: DataFrame, column: str, order_by: Names, key: Names = None) -> DataFrame:
        """State: key columns and ``mode``."""
        at = Layout.of(df, column, None, order_by, key)
        place = F.struct(*_quoted(at.order_by))
        by_value = df.where(F.col(f"`{column}`").isNotNull()).groupBy(*_quoted(at.key), F.col(f"`{column}`").alias("__v")).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
        most = by_value.groupBy(*_quoted(at.key)).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("f"), F.col("__v").alias("v"))).alias("__m"))
        return most.select(*_quoted(at.key), F.col("__m.v").alias("mode"))

    def transform(self, df: DataFrame, column: str, state: DataFrame, key: Names = None, name: str = "imputed") -> DataFrame:
        met = with_state(df, state.withColumnRenamed("mode", "__mode"), names(key))
        return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(f"`{column}`"), F.col("__mode")).alias(name))

    def prefix(self, df: DataFrame, column: str, order_by: Names, key: Names = None, name: str = "imputed") -> DataFrame:
        """All columns of ``df`` and the value or the mode of the values before it.

        Counts only grow, so the mode so far is the value at which the largest
        running count was reached, the one of earliest first sight of equals.
        """
        at = Layout.of(df, column, None, order_by, key)
        blocks = order_blocks(df, at.order_by)
        numbered = row_numbers(df, at.order_by, at.key, "__rn", blocks)
        value = F.col(f"`{column}`")
        counted = prefix(numbered, {"__n": ("count", value), "__first": ("min", F.when(value.isNotNull(), F.col("__rn")))}, at.order_by, (*at.key, column), blocks=blocks)
        mark = F.when(value.isNotNull(), F.struct(F.col("__n").alias("n"), (-F.col("__first")).alias("f"), value.alias("v")))
        run = prefix(counted, {"__m": ("max", mark)}, at.order_by, at.key, blocks=blocks)
        return run.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(value, F.col("__m.v")).alias(name))
