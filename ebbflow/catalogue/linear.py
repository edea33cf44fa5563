"""Least squares queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import EVENTS, LINEITEM, NUDGE, ORDER, events, lineitem
from ebbflow.operators.linear import Regression

_KEYS = ["quantity", "discount", "tax"]


def _named(frame):
    return frame.select("n", F.round(F.get("coef", F.lit(0)), 6).alias("intercept"), F.round(F.get("coef", F.lit(1)), 6).alias("slope"))


def linreg_coef_1d(spark, sf_dir):
    return _named(Regression().fit(lineitem(spark, sf_dir), "quantity", "price").coefficients())


def linreg_by_key(spark, sf_dir):
    out = Regression().fit(lineitem(spark, sf_dir), "quantity", "price", "l_returnflag").coefficients()
    return out.select("l_returnflag", "n", F.round(F.get("coef", F.lit(0)), 6).alias("intercept"), F.round(F.get("coef", F.lit(1)), 6).alias("slope"))


def linreg_normal_equations(spark, sf_dir):
    """Means of the products: pair numbers of ``price, quantity, discount, tax``."""
    state = Regression().fit(lineitem(spark, sf_dir), _KEYS, "price").state
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    entry = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(v / F.col("n"), 6).alias("value"))
    cells = [entry(i + 1, j + 1, F.get("sxx", F.lit(k))) for k, (i, j) in enumerate(pairs)]
    cells += [entry(0, i + 1, F.get("sxy", F.lit(i))) for i in range(3)]
    return state.select("n", F.explode(F.array(*cells)).alias("c")).select("n", "c.i", "c.j", "c.value")


def linreg_merge_equals_whole(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    halves = [Regression().fit(rows.where(F.col("l_orderkey") % 2 == k), "quantity", "price") for k in (0, 1)]
    return _named(halves[0].merge(halves[1]).coefficients())


def linreg_prefix_predict(spark, sf_dir):
    out = Regression().prefix(events(spark, sf_dir), "x2", "x1", ORDER, "user_id")
    return out.select("event_id", "user_id", F.round(F.col("y_pred") + NUDGE, 6).alias("y_pred"))


_ONE = "count(*) AS n, round(regr_intercept(price, quantity), 6) AS intercept, round(regr_slope(price, quantity), 6) AS slope"
_NAMES = ["price", *_KEYS]
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
QUERIES = {
    "linreg_coef_1d": linreg_coef_1d, "linreg_by_key": linreg_by_key, "linreg_normal_equations": linreg_normal_equations,
    "linreg_merge_equals_whole": linreg_merge_equals_whole, "linreg_prefix_predict": linreg_prefix_predict,
}
ORACLES = {
    "linreg_coef_1d": f"SELECT {_ONE} FROM ({LINEITEM})",
    "linreg_by_key": f"SELECT l_returnflag, {_ONE} FROM ({LINEITEM}) GROUP BY l_returnflag",
    "linreg_normal_equations": " UNION ALL ".join(
        f"SELECT count(*) AS n, {i}::INTEGER AS i, {j}::INTEGER AS j, round(avg({_NAMES[i]} * {_NAMES[j]}), 6) AS value FROM ({LINEITEM})" for i, j in _PAIRS
    ),
    "linreg_merge_equals_whole": f"SELECT {_ONE} FROM ({LINEITEM})",
    "linreg_prefix_predict": f"""SELECT event_id, user_id, round(CASE WHEN b IS NULL OR isnan(b) OR isinf(b) THEN 0 ELSE a + b * x2 END + {NUDGE!r}::DOUBLE, 6) AS y_pred FROM (
        SELECT *, regr_slope(x1, x2) OVER w AS b, regr_intercept(x1, x2) OVER w AS a FROM ({EVENTS})
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
}
