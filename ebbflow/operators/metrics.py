"""Metrics as aggregates of named columns ``pred`` and ``label``.

Each works as an aggregate, over a running or rolling window, and on a stream.
Rows with a null prediction or label take no part. Over no rows a metric has
its ``empty`` value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ebbflow.plans.layout import Names, names
from ebbflow.plans.windows import Blocks, prefix, sliding

Over = Callable[[Column], Column]


class Metric:
    """``sums`` are what is added up over rows; ``value`` combines them."""

    empty: float = 0.0

    def sums(self, pred: Column, label: Column) -> dict[str, Column]:
        raise NotImplementedError

    def value(self, s: dict[str, Column]) -> Column:
        raise NotImplementedError

    def count(self, s: dict[str, Column]) -> Column:
        """Rows that the metric speaks of."""
        return s["n"]

    def _known(self, pred: Column, label: Column) -> dict[str, Column]:
        known = pred.isNotNull() & label.isNotNull()
        return {k: F.when(known, v.cast("double")) for k, v in self.sums(pred, label).items()}

    def aggregate(self, pred: str | Column = "pred", label: str | Column = "label") -> Column:
        """An aggregate expression for ``agg``."""
        return self.value({k: F.coalesce(F.sum(v), F.lit(0.0)) for k, v in self._known(_col(pred), _col(label)).items()})

    def over(self, window: WindowSpec, pred: str | Column = "pred", label: str | Column = "label") -> Column:
        return self.value({k: F.coalesce(F.sum(v).over(window), F.lit(0.0)) for k, v in self._known(_col(pred), _col(label)).items()})

    def score(self, df: DataFrame, pred: str = "pred", label: str = "label", key: Names = None, name: str = "value") -> DataFrame:
        """One value, or one for each key."""
        return df.groupBy(*[F.col(f"`{k}`") for k in names(key)]).agg(self.aggregate(pred, label).alias(name))

    def running(self, df: DataFrame, order_by: Names, key: Names = None, pred: str = "pred", label: str = "label", name: str = "value", count: str | None = None, blocks: Blocks | None = None) -> DataFrame:
        """All columns of ``df`` and the metric of the rows up to each, with its count as ``count``; a key's rows may lie in many tasks."""
        parts = self._known(_col(pred), _col(label))
        summed = prefix(df, {f"__m_{k}": ("sum", v) for k, v in parts.items()}, order_by, key, blocks=blocks)
        sums = {k: F.coalesce(F.col(f"__m_{k}"), F.lit(0.0)) for k in parts}
        out = summed.withColumn(name, self.value(sums))
        if count:
            out = out.withColumn(count, self.count(sums))
        return out.drop(*[f"__m_{k}" for k in parts])

    def rolling(self, df: DataFrame, window_size: int, order_by: Names, key: Names = None, pred: str = "pred", label: str = "label", name: str = "value") -> DataFrame:
        """All columns of ``df`` and the metric of the last ``window_size`` rows, the row included."""
        parts = self._known(_col(pred), _col(label))
        summed = sliding(df, {f"__m_{k}": F.sum(v) for k, v in parts.items()}, window_size, order_by, key)
        value = self.value({k: F.coalesce(F.col(f"__m_{k}"), F.lit(0.0)) for k in parts})
        return summed.withColumn(name, value).drop(*[f"__m_{k}" for k in parts])


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


class Accuracy(Metric):
    def sums(self, pred, label):
        return {"n": F.lit(1), "right": (pred == label).cast("int")}

    def value(self, s):
        return _share(s["right"], s["n"])


class _ByClass(Metric):
    def __init__(self, positive_class: int = 1):
        self.positive_class = positive_class

    def sums(self, pred, label):
        said, true = pred == self.positive_class, label == self.positive_class
        return {"tp": (said & true).cast("int"), "fp": (said & ~true).cast("int"), "fn": (~said & true).cast("int")}


class Precision(_ByClass):
    def value(self, s):
        return _share(s["tp"], s["tp"] + s["fp"])

    def count(self, s):
        return s["tp"] + s["fp"]


class Recall(_ByClass):
    def value(self, s):
        return _share(s["tp"], s["tp"] + s["fn"])

    def count(self, s):
        return s["tp"] + s["fn"]


class F1Score(_ByClass):
    def value(self, s):
        return _share(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"])

    def count(self, s):
        return 2 * s["tp"] + s["fp"] + s["fn"]


class _Error(Metric):
    def error(self, gap: Column) -> Column:
        raise NotImplementedError

    def sums(self, pred, label):
        return {"n": F.lit(1), "e": self.error(pred.cast("double") - label.cast("double"))}

    def value(self, s):
        return _share(s["e"], s["n"])


class MAE(_Error):
    def error(self, gap):
        return F.abs(gap)


class MSE(_Error):
    def error(self, gap):
        return gap * gap


class RMSE(MSE):
    def value(self, s):
        return F.sqrt(super().value(s))


class R2(Metric):
    """NaN below two rows; 1 if the labels don't vary."""

    empty = float("nan")

    def sums(self, pred, label):
        p, t = pred.cast("double"), label.cast("double")
        return {"n": F.lit(1), "t": t, "tt": t * t, "e": (p - t) * (p - t)}

    def value(self, s):
        spread = s["tt"] - s["t"] * s["t"] / F.when(s["n"] > 0, s["n"]).otherwise(1)
        return F.when(s["n"] < 2, float("nan")).when(spread <= 0, 1.0).otherwise(1 - s["e"] / F.when(spread > 0, spread).otherwise(1.0))


class RollingMetric:
    """A metric, with its own settings, over the last ``window_size`` rows."""

    def __init__(self, metric: Metric, window_size: int = 100):
        if window_size <= 0:
            raise ValueError("window_size must be positive")
        self.metric, self.window_size = metric, window_size

    def running(self, df: DataFrame, order_by: Names, key: Names = None, pred: str = "pred", label: str = "label", name: str = "value") -> DataFrame:
        return self.metric.rolling(df, self.window_size, order_by, key, pred, label, name)

    def over(self, pred: str, label: str, order_by: Names, key: Names = None) -> Column:
        frame = Window.partitionBy(*[F.col(f"`{k}`") for k in names(key)]).orderBy(*[F.col(f"`{o}`") for o in names(order_by)])
        return self.metric.over(frame.rowsBetween(-(self.window_size - 1), 0), pred, label)
