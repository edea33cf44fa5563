"""Nearest neighbours, window tests and slices of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import ORDER, dimensions, dimensions_sql, events
from ebbflow.functions.expressions import ks_critical
from ebbflow.operators.drift import KSWIN
from ebbflow.operators.neighbours import KNN
from ebbflow.sources.streams import batch_stream, skip_stream, take_stream

D, K, W = 64, 5, 100
_KNN = KNN(k=K, window_size=W)


def knn_predict_static(spark, sf_dir):
    """All rows against the last 100."""
    rows, names = dimensions(spark, sf_dir, D)
    out = _KNN.fit(rows, names, "label", "vec_id").predict(rows)
    return out.select("vec_id", "y_pred", F.round(F.coalesce(F.try_element_at("proba", F.col("y_pred")), F.lit(0.0)), 6).alias("share"))


def knn_prequential(spark, sf_dir):
    """Each row against the 100 before it."""
    rows, names = dimensions(spark, sf_dir, D)
    out = _KNN.prequential_parts(rows, names, "label", "vec_id")
    return out.select("vec_id", "y_pred", F.round(F.coalesce(F.try_element_at("proba", F.col("y_pred")), F.lit(0.0)), 6).alias("share"))


def kswin_status(spark, sf_dir):
    return KSWIN(0.05, 60, 20).windowed(events(spark, sf_dir), "value", ORDER, "event_type").select("event_id", "event_type", "status")


def take_skip_batch(spark, sf_dir):
    """Rows 101 to 600 in batches of 64."""
    rows = take_stream(skip_stream(events(spark, sf_dir), 100, ORDER), 500, ORDER)
    return batch_stream(rows, 64, ORDER).select("event_id", "batch_id")


def take_by_key(spark, sf_dir):
    """The first three events of each user."""
    return take_stream(events(spark, sf_dir), 3, ORDER, "user_id").select("user_id", "event_id")


def _vote(pairs: str) -> str:
    """``pairs``: query, neighbour's label, distance and age."""
    return f"""WITH d AS ({dimensions_sql(D)}), r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM d), pairs AS ({pairs}),
        near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, age) AS k FROM pairs),
        votes AS (SELECT q, label, sum(CASE WHEN dist = 0 THEN 1e10 ELSE 1 / dist END) AS v FROM near WHERE k <= {K} GROUP BY q, label),
        best AS (SELECT q, arg_min(label, (-v, label)) AS y, max(v) / sum(v) AS share FROM votes GROUP BY q)
        SELECT vec_id, coalesce(y, 0)::INTEGER AS y_pred, round(coalesce(share, 0), 6) AS share FROM d LEFT JOIN best ON q = vec_id"""


_DISTANCE = "sqrt(" + " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(D)) + ")"
_CRITICAL = ks_critical(20, 20, 0.05)

QUERIES = {f.__name__: f for f in (knn_predict_static, knn_prequential, kswin_status, take_skip_batch, take_by_key)}
ORACLES = {
    "knn_predict_static": _vote(f"SELECT a.vec_id AS q, b.label, {_DISTANCE} AS dist, b.rn AS age FROM r a, r b WHERE b.rn > (SELECT max(rn) FROM r) - {W}"),
    "knn_prequential": _vote(f"SELECT a.vec_id AS q, b.label, {_DISTANCE} AS dist, b.rn AS age FROM r a JOIN r b ON b.rn BETWEEN a.rn - {W} AND a.rn - 1"),
    "kswin_status": f"""WITH w AS (SELECT event_id, event_type, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM events),
        g AS (SELECT event_id, event_type, l[1:20] AS a, l[41:60] AS b, len(l) AS n FROM w),
        u AS (SELECT event_id, event_type, n, a, b, unnest(list_concat(a, b)) AS v FROM g),
        k AS (SELECT event_id, event_type, any_value(n) AS n, max(abs(len(list_filter(a, lambda x: x <= v)) / 20.0 - len(list_filter(b, lambda x: x <= v)) / 20.0))::DOUBLE AS gap FROM u GROUP BY event_id, event_type)
        SELECT event_id, event_type, (CASE WHEN n < 60 THEN 0 WHEN gap > {_CRITICAL!r}::DOUBLE THEN 2 WHEN gap > {_CRITICAL!r}::DOUBLE * 0.8::DOUBLE THEN 1 ELSE 0 END)::INTEGER AS status FROM k""",
    "take_skip_batch": "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 500 OFFSET 100)",
    "take_by_key": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3",
}
