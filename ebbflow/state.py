"""Learned states as Parquet tables: save, load, merge."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def save(fitted: Any, path: str) -> None:
    """Writes the state of a fitted operator; fails if something is there."""
    fitted.state.write.mode("errorifexists").parquet(path)


def load(like: Any, spark: SparkSession, path: str) -> Any:
    """The fitted operator ``like`` with the stored state in place of its own."""
    from dataclasses import replace

    return replace(like, state=spark.read.parquet(path))


def merge(a: Any, b: Any) -> Any:
    """One model of two models' rows, where the operator's state is a sum."""
    if not hasattr(a, "merge"):
        raise TypeError(f"states of {type(a).__name__} depend on the order of rows and don't merge")
    return a.merge(b)


def dict_argmax(weights: dict) -> Any:
    """Key of the greatest value, the least key of several; 0 if empty."""
    return min(weights, key=lambda k: (-weights[k], k)) if weights else 0


__all__ = ["dict_argmax", "load", "merge", "save"]
