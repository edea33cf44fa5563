"""Which columns are features, target, order and key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = str | Sequence[str] | None


def names(value: Names) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class Layout:
    """``order_by`` must be a total order within each ``key``: the engine has no arrival order of its own."""

    features: tuple[str, ...] = ()
    target: str | None = None
    order_by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, features: Names = None, target: str | None = None, order_by: Names = None, key: Names = None, *, ordered: bool = True, exclude: Names = None) -> Layout:
        """Checks names against ``df``. Without ``features``, all columns but target, order, key and ``exclude``."""
        order, keys, out = names(order_by), names(key), names(exclude)
        if target is not None and target not in df.columns:
            raise ValueError(f"no target column {target!r}")
        chosen = names(features) if features is not None else tuple(c for c in df.columns if c not in {target, *order, *keys, *out})
        missing = [c for c in (*chosen, *order, *keys) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if not chosen:
            raise ValueError("no feature columns")
        if ordered and not order:
            raise ValueError("order_by is needed: the result depends on the order of rows")
        return cls(chosen, target, order, keys)


def assert_total_order(df: DataFrame, order_by: Names, key: Names = None) -> None:
    """Raises if two rows of a key share their place. One aggregation; meant for debugging."""
    columns = [*names(key), *names(order_by)]
    twice = df.groupBy(*[F.col(f"`{c}`") for c in columns]).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{columns} is not a total order: {twice[0].asDict()}")


def masked(df: DataFrame, key: tuple[str, ...], values: list[Column]) -> DataFrame:
    """``__k0, ...`` and ``__v0, ...``: keys, and doubles that are all null in rows where any is null or NaN.

    For aggregates, which skip nulls. A filter would say the same, but is pushed
    below whatever computes the values, so they would be computed twice.
    """
    keys = [f"__k{i}" for i in range(len(key))]
    held = [f"__v{i}" for i in range(len(values))]
    known = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in held) or "true"
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(key, keys, strict=True)], *[v.cast("double").alias(n) for v, n in zip(values, held, strict=True)])
    rows = rows.selectExpr(*keys, *held, f"{known} AS __known")
    return rows.selectExpr(*keys, *[f"CASE WHEN __known THEN {v} END AS {v}" for v in held])
