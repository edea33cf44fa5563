"""Registered queries over the driver's tables, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbflow.catalogue import bayes, detectors, learners, linear, rules, sources, statistics, windows

MODULES = (bayes, linear, statistics, windows, detectors, learners, sources, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
