"""Evaluation protocols over any ordered frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.metrics import Metric
from ebbflow.plans.layout import Names, names
from ebbflow.plans.windows import Blocks, order_blocks, row_numbers


@dataclass
class Scored:
    """``rows``: every evaluated row with ``y_pred``; ``trajectory``: order columns and the running metric; ``score``: one row for each key."""

    rows: DataFrame
    trajectory: DataFrame
    score: DataFrame


def _asked(model, df: DataFrame, features: Names, target: str, order_by: Names, key: Names, n_samples: int | None, blocks: Blocks) -> DataFrame:
    """Test-then-train rows, numbered from 1 in ``__i``; the first of a key is not scored, since nothing was learned before it."""
    numbered = row_numbers(df, order_by, key, "__i", blocks)
    if n_samples is not None:
        numbered = numbered.where(F.col("__i") <= n_samples)
    return model.prequential(numbered, features, target, order_by, key)


def progressive_val_score(model, df: DataFrame, metric: Metric, features: Names, target: str, order_by: Names, key: Names = None, n_samples: int | None = 1000) -> Scored:
    """Predict, score, learn, for the first ``n_samples`` rows of each key (all, if None).

    The first row is learned and not scored. Without scored rows the score is NaN.
    """
    blocks = order_blocks(df, order_by)
    asked = _asked(model, df, features, target, order_by, key, n_samples, blocks)
    scored = asked.where(F.col("__i") > 1)
    run = metric.running(scored, order_by, key, "y_pred", target, "__value", count="__count", blocks=blocks)
    kept = [F.col(f"`{c}`") for c in (*names(key), *names(order_by))]
    trajectory = run.where(F.col("__count") > 0).select(*kept, F.col("__value").alias("value"))
    value = F.when(F.count(F.when(F.col("__i") > 1, 1)) > 0, _where(metric, target)).otherwise(float("nan"))
    score = asked.groupBy(*[F.col(f"`{k}`") for k in names(key)]).agg(value.alias("score"))
    return Scored(scored.drop("__i"), trajectory, score)


def _where(metric: Metric, target: str):
    """The metric over rows past the first."""
    later = F.col("__i") > 1
    return metric.aggregate(F.when(later, F.col("y_pred")), F.when(later, F.col(f"`{target}`")))


def holdout_score(model, df: DataFrame, metric: Metric, features: Names, target: str, order_by: Names, key: Names = None, train_size: int = 1000, test_size: int = 500) -> DataFrame:
    """Learns the first ``train_size`` rows of each key and scores the next ``test_size`` with what was learned."""
    numbered = row_numbers(df, order_by, key, "__i")
    fitted = model.fit(numbered.where(F.col("__i") <= train_size), features, target, order_by, key)
    test = numbered.where((F.col("__i") > train_size) & (F.col("__i") <= train_size + test_size))
    return metric.score(fitted.predict(test), "y_pred", target, key, "score")


def interleaved_test_then_train(model, df: DataFrame, metric: Metric, features: Names, target: str, order_by: Names, key: Names = None, n_samples: int | None = 1000, period: int = 100) -> Scored:
    """``progressive_val_score`` whose ``trajectory`` holds the metric of every ``period``-th row by itself."""
    asked = _asked(model, df, features, target, order_by, key, n_samples, order_blocks(df, order_by))
    scored = asked.where(F.col("__i") > 1)
    kept = [F.col(f"`{c}`") for c in (*names(key), *names(order_by))]
    single = metric.value({k: F.coalesce(v, F.lit(0.0)) for k, v in metric._known(F.col("y_pred"), F.col(f"`{target}`")).items()})
    periodic = scored.where(F.col("__i") % period == 0).select(*kept, single.alias("value"))
    value = F.when(F.count(F.when(F.col("__i") > 1, 1)) > 0, _where(metric, target)).otherwise(float("nan"))
    return Scored(scored.drop("__i"), periodic, asked.groupBy(*[F.col(f"`{k}`") for k in names(key)]).agg(value.alias("score")))
