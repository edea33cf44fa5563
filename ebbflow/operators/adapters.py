"""Config and fitted objects apart, and label pools: for callers that expect estimators."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.base import Fitted, Sequential
from ebbflow.operators.bayes import GaussianNB
from ebbflow.operators.linear import FittedRegression, LogisticRegression, Perceptron, Regression
from ebbflow.operators.neighbours import KNN
from ebbflow.operators.trees import HoeffdingTree
from ebbflow.plans.layout import Names


@dataclass(frozen=True)
class Config:
    """An operator with settings and nothing learned. ``fit`` never changes it."""

    op: Any

    def fit(self, df: DataFrame, features: Names, target: str, order_by: Names = None, key: Names = None) -> Model:
        if isinstance(self.op, Model | Fitted | FittedRegression):
            raise TypeError("a fitted model is no config")
        if isinstance(self.op, Regression):
            return Model(self, self.op.fit(df, features, target, key))
        return Model(self, self.op.fit(df, features, target, order_by, key))


@dataclass(frozen=True)
class Model:
    """A config and its learned state. ``update_observations`` gives a new model and leaves this one as it is."""

    config: Config
    fitted: Any

    def predict(self, df: DataFrame) -> DataFrame:
        return self.fitted.predict(df)

    def update_observations(self, df: DataFrame) -> Model:
        return Model(self.config, self.fitted.update(df))

    @property
    def fitted_params(self) -> DataFrame:
        return self.fitted.state


def learnapi(op: Any) -> Config:
    """An operator as a config; only operators with nothing learned are taken."""
    if isinstance(op, Model | Fitted | FittedRegression):
        raise TypeError("a fitted model is no config")
    return Config(op)


class LabelledClassifier:
    """A classifier over any labels, by a pool of known labels.

    Labels are numbered in their order, from ``first`` (0 for the two-class
    learners, 1 for the others). A label outside the pool is refused before
    anything is learned.
    """

    def __init__(self, op: Sequential, labels: list, binary: bool = False):
        if binary and len(labels) != 2:
            raise ValueError("a binary classifier takes exactly two labels")
        self.op, self.labels, self.first = op, sorted(labels), 0 if binary else 1

    def codes(self, df: DataFrame) -> DataFrame:
        """The pool as a table ``code, label``."""
        return df.sparkSession.createDataFrame([(i + self.first, v) for i, v in enumerate(self.labels)], ["code", "label"])

    def _encoded(self, df: DataFrame, target: str) -> DataFrame:
        unknown = df.where(F.col(f"`{target}`").isNotNull() & ~F.col(f"`{target}`").isin(self.labels)).select(target).limit(1).collect()
        if unknown:
            raise ValueError(f"label {unknown[0][0]!r} is not in the pool {self.labels}")
        code = F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(f"`{target}`")) - 1 + self.first
        return df.withColumn("__code", F.when(F.col(f"`{target}`").isNotNull(), code).cast("int"))

    def fit(self, df: DataFrame, features: Names, target: str, order_by: Names, key: Names = None) -> LabelledModel:
        return LabelledModel(self, target, self.op.fit(self._encoded(df, target), features, "__code", order_by, key))


@dataclass(frozen=True)
class LabelledModel:
    config: LabelledClassifier
    target: str
    fitted: Any

    def update_observations(self, df: DataFrame) -> LabelledModel:
        """Checks all labels first; then learns. This model stays as it is."""
        return LabelledModel(self.config, self.target, self.fitted.update(self.config._encoded(df, self.target)))

    def predict(self, df: DataFrame, name: str = "y_label") -> DataFrame:
        """``predict`` of the classifier with the label's own value as ``name``, null for a number outside the pool."""
        out = self.fitted.predict(df)
        return out.withColumn(name, F.get(F.array(*[F.lit(v) for v in self.config.labels]), F.col("y_pred") - self.config.first))

    @property
    def fitted_params(self) -> DataFrame:
        return self.fitted.state


def logistic_classifier(labels: list, **settings) -> LabelledClassifier:
    return LabelledClassifier(LogisticRegression(**settings), labels, binary=True)


def perceptron_classifier(labels: list, **settings) -> LabelledClassifier:
    return LabelledClassifier(Perceptron(**settings), labels, binary=True)


def naive_bayes_classifier(labels: list, **settings) -> LabelledClassifier:
    return LabelledClassifier(GaussianNB(**settings), labels)


def tree_classifier(labels: list, max_depth: int = 20, **settings) -> LabelledClassifier:
    return LabelledClassifier(HoeffdingTree(max_depth=max_depth, **settings), labels)


def knn_classifier(labels: list, **settings) -> LabelledClassifier:
    return LabelledClassifier(KNN(**settings), labels)
