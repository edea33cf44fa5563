"""Scalers, encoders, imputers, metrics, composition, projections and half-space trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import EVENTS, LINEITEM, NUDGE, ORDER, dimensions, dimensions_sql, events, lineitem, rounded, table
from ebbflow.operators import metrics as M
from ebbflow.operators.anomaly import GaussianProjectionDetector, HalfSpaceTrees
from ebbflow.operators.compose import ColumnTransformer, FeatureUnion
from ebbflow.operators.transform import MaxAbsScaler, MeanImputer, MinMaxScaler, ModeImputer, OneHotEncoder, OrdinalEncoder, StandardScaler, TargetEncoder

#: Fixed directions of the projection query.
#: Three directions in 64 dimensions, of length 1: signs by single bits of the dimension's number.
DIRECTIONS = [[(1 - 2 * (j >> k & 1)) / 8 for j in range(64)] for k in (0, 2, 5)]
FOREST = HalfSpaceTrees(n_trees=3, height=3, window_size=250, seed=5, bounds=(0.0, 5.0))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"))


def standard_scale_batch(spark, sf_dir):
    rows = events(spark, sf_dir)
    return StandardScaler().fit(rows, "value", "user_id").transform(rows, "_scaled").select("event_id", F.round("value_scaled", 6).alias("scaled"))


def standard_scale_prefix(spark, sf_dir):
    return StandardScaler().prefix(events(spark, sf_dir), "value", ORDER, "user_id", suffix="_scaled").select("event_id", F.round("value_scaled", 6).alias("scaled"))


def standard_scale_inverse(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    model = StandardScaler().fit(rows, ["a", "b"])
    return model.inverse_transform(model.transform(rows)).select("c_custkey", rounded("a"), rounded("b"))


def minmax_scale(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return MinMaxScaler().fit(rows, ["a", "b"], "c_nationkey").transform(rows).select("c_custkey", rounded("a"), rounded("b"))


def minmax_scale_prefix(spark, sf_dir):
    return MinMaxScaler().prefix(events(spark, sf_dir), "value", ORDER, "user_id", inclusive=False, suffix="_scaled").select("event_id", F.round("value_scaled", 6).alias("scaled"))


def maxabs_scale(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return MaxAbsScaler().fit(rows, ["a", "b"]).transform(rows).select("c_custkey", rounded("a"), rounded("b"))


def maxabs_inverse(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    model = MaxAbsScaler().fit(rows, ["a", "b"])
    return model.inverse_transform(model.transform(rows)).select("c_custkey", rounded("a"), rounded("b"))


def onehot(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = OneHotEncoder().fit(rows, "event_type", ORDER).transform(rows, "v")
    return out.select("event_id", F.posexplode("v").alias("place", "value"))


def ordinal(spark, sf_dir):
    rows = events(spark, sf_dir)
    return OrdinalEncoder().fit(rows, "event_type", ORDER, "user_id").transform(rows, "code").select("event_id", "code")


def target_encode_batch(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    out = TargetEncoder(10.0).fit(rows, "l_suppkey", "price").transform(rows)
    return out.select("l_suppkey", F.round("encoded", 6).alias("encoded")).distinct()


def target_encode_prefix(spark, sf_dir):
    return TargetEncoder(1.0).prefix(events(spark, sf_dir), "event_type", "value", ORDER, "user_id").select("event_id", F.round(F.col("encoded") + NUDGE, 6).alias("encoded"))


def _blanked(spark, sf_dir):
    """Every seventh value and type is blank."""
    seventh = F.col("event_id") % 7 == 0
    return events(spark, sf_dir).withColumns({"value": F.when(~seventh, F.col("value")), "event_type": F.when(~seventh, F.col("event_type"))})


def mean_impute_prefix(spark, sf_dir):
    return MeanImputer().prefix(_blanked(spark, sf_dir), "value", ORDER, "user_id").select("event_id", F.round(F.col("imputed") + NUDGE, 6).alias("imputed"))


def mode_impute_prefix(spark, sf_dir):
    return ModeImputer().prefix(_blanked(spark, sf_dir), "event_type", ORDER, "user_id").select("event_id", "imputed")


def mode_impute_batch(spark, sf_dir):
    rows = _blanked(spark, sf_dir)
    op = ModeImputer()
    return op.transform(rows, "event_type", op.fit(rows, "event_type", ORDER, "user_id"), "user_id").select("event_id", "imputed")


def classification_metrics(spark, sf_dir):
    """Toxic documents as a guess at bad quality."""
    rows = table(spark, sf_dir, "labels").select((1 - F.col("toxic")).alias("pred"), F.col("quality").alias("label"))
    parts = {"accuracy": M.Accuracy(), "precision": M.Precision(), "recall": M.Recall(), "f1": M.F1Score(), "precision_0": M.Precision(0), "recall_0": M.Recall(0)}
    return rows.agg(*[F.round(m.aggregate(), 6).alias(name) for name, m in parts.items()])


def regression_metrics(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_returnflag", (F.col("quantity") * 15).alias("pred"), F.col("price").alias("label"))
    parts = {"mae": M.MAE(), "mse": M.MSE(), "rmse": M.RMSE(), "r2": M.R2()}
    return rows.groupBy("l_returnflag").agg(*[F.round(m.aggregate(), 6).alias(name) for name, m in parts.items()])


def running_accuracy(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"pred": (F.col("value") > 60).cast("int"), "label": F.col("y")})
    return M.Accuracy().running(rows, ORDER, "user_id").select("event_id", rounded("value"))


def rolling_accuracy_100(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"pred": (F.col("value") > 60).cast("int"), "label": F.col("y")})
    return M.RollingMetric(M.Accuracy(), 100).running(rows, ORDER, "event_type", name="score").select("event_id", rounded("score"))


def rolling_mae_100(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"pred": F.lit(50.0), "label": F.col("value")})
    return M.RollingMetric(M.MAE(), 100).running(rows, ORDER, name="score").select("event_id", rounded("score"))


def feature_union(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    out = FeatureUnion(StandardScaler(), MinMaxScaler()).fit(rows, ["a", "b"]).transform(rows)
    return out.select("c_custkey", F.posexplode("features").alias("place", "value")).select("c_custkey", "place", rounded("value"))


def column_transformer(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    out = ColumnTransformer([("left", StandardScaler(), "a"), ("right", MaxAbsScaler(), "b")]).fit(rows, ["a", "b"]).transform(rows)
    return out.select("c_custkey", F.posexplode("features").alias("place", "value")).select("c_custkey", "place", rounded("value"))


def gaussian_projection_score(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, 64)
    model = GaussianProjectionDetector(3, directions=DIRECTIONS).fit(rows, names)
    return model.score_one(rows).select("vec_id", rounded("score_one"))


def gaussian_projection_prequential(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, 64)
    return GaussianProjectionDetector(3, directions=DIRECTIONS).prequential(rows, names, "vec_id").select("vec_id", rounded("score_one"))


def half_space_trees_score(spark, sf_dir):
    out = FOREST.prequential_parts(events(spark, sf_dir), "x1", ORDER)
    return out.select("event_id", rounded("score"), rounded("score_one"))


_CUSTOMER = "SELECT c_custkey, c_nationkey, c_acctbal / 1000 AS a, (c_custkey % 97)::DOUBLE AS b FROM customer"
_RUN = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND"
_BLANKED = "SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events"
_SD = lambda c: f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END"
_MM = lambda c, w="": f"CASE WHEN max({c}) OVER ({w}) > min({c}) OVER ({w}) THEN ({c} - min({c}) OVER ({w})) / (max({c}) OVER ({w}) - min({c}) OVER ({w})) ELSE 0 END"
_MA = lambda c: f"CASE WHEN max(abs({c})) OVER () > 0 THEN {c} / max(abs({c})) OVER () ELSE {c} END"


def _wide(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT c_custkey, {i}::INTEGER AS place, round({p}, 6) AS value FROM ({_CUSTOMER})" for i, p in enumerate(parts))


def _leaf(tree: int) -> str:
    """The leaf of ``x1`` in a tree over one feature, as nested CASEs."""
    cuts = FOREST.trees(1)[1][tree]

    def at(node: int) -> str:
        if node >= len(cuts):
            return str(node - len(cuts))
        return f"CASE WHEN x1 < {float(cuts[node])!r} THEN {at(2 * node + 1)} ELSE {at(2 * node + 2)} END"

    return at(0)


def _projected(window: str) -> str:
    lines = [" + ".join(f"e{j} * {w!r}::DOUBLE" for j, w in enumerate(d)) for d in DIRECTIONS]
    z = [f"CASE WHEN var_samp(p{i}) {window} > 2.220446049250313e-16 THEN abs(p{i} - avg(p{i}) {window}) / sqrt(var_samp(p{i}) {window}) ELSE 0 END" for i in range(3)]
    return f"""SELECT vec_id, round(CASE WHEN n < 2 THEN 0.5 ELSE 1 / (1 + exp(-(z / 3 - 2.0))) END, 6) AS score_one FROM (
        SELECT vec_id, count(*) {window} AS n, {" + ".join(z)} AS z FROM (SELECT vec_id, {", ".join(f"{p} AS p{i}" for i, p in enumerate(lines))} FROM ({dimensions_sql(64)})))"""


_SHARE = lambda a, b: f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END, 6)"

QUERIES = {
    f.__name__: f
    for f in (
        standard_scale_batch, standard_scale_prefix, standard_scale_inverse, minmax_scale, minmax_scale_prefix, maxabs_scale, maxabs_inverse, onehot, ordinal,
        target_encode_batch, target_encode_prefix, mean_impute_prefix, mode_impute_prefix, mode_impute_batch, classification_metrics, regression_metrics,
        running_accuracy, rolling_accuracy_100, rolling_mae_100, feature_union, column_transformer, gaussian_projection_score, gaussian_projection_prequential,
        half_space_trees_score,
    )
}
ORACLES = {
    "standard_scale_batch": "SELECT event_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)",
    "standard_scale_prefix": f"SELECT event_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) AS scaled FROM events WINDOW w AS ({_RUN} CURRENT ROW)",
    "standard_scale_inverse": f"SELECT c_custkey, round(a, 6) AS a, round(b, 6) AS b FROM ({_CUSTOMER})",
    "minmax_scale": f"SELECT c_custkey, round({_MM('a', 'PARTITION BY c_nationkey')}, 6) AS a, round({_MM('b', 'PARTITION BY c_nationkey')}, 6) AS b FROM ({_CUSTOMER})",
    "minmax_scale_prefix": f"SELECT event_id, round(CASE WHEN min(value) OVER w IS NULL THEN value WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled FROM events WINDOW w AS ({_RUN} 1 PRECEDING)",
    "maxabs_scale": f"SELECT c_custkey, round({_MA('a')}, 6) AS a, round({_MA('b')}, 6) AS b FROM ({_CUSTOMER})",
    "maxabs_inverse": f"SELECT c_custkey, round(a, 6) AS a, round(b, 6) AS b FROM ({_CUSTOMER})",
    "onehot": """WITH c AS (SELECT event_type, row_number() OVER (ORDER BY min(ts), arg_min(event_id, (ts, event_id))) - 1 AS k FROM events GROUP BY event_type), n AS (SELECT unnest(range(count(*))) AS place FROM c)
        SELECT event_id, place::INTEGER AS place, (k = place)::INTEGER::DOUBLE AS value FROM events JOIN c USING (event_type), n""",
    "ordinal": """WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min((ts, event_id))) AS k FROM events GROUP BY user_id, event_type)
        SELECT event_id, k::DOUBLE AS code FROM events JOIN c USING (user_id, event_type)""",
    "target_encode_batch": f"WITH a AS (SELECT avg(price) AS g FROM ({LINEITEM})) SELECT l_suppkey, round(count(*) / (count(*) + 10.0) * avg(price) + (1 - count(*) / (count(*) + 10.0)) * any_value(g), 6) AS encoded FROM ({LINEITEM}), a GROUP BY l_suppkey",
    "target_encode_prefix": f"""SELECT event_id, round(CASE WHEN n > 0 THEN n / (n + 1.0) * m + (1 - n / (n + 1.0)) * g ELSE coalesce(g, 0) END + {NUDGE!r}::DOUBLE, 6) AS encoded FROM (
        SELECT event_id, count(value) OVER c AS n, avg(value) OVER c AS m, avg(value) OVER w AS g FROM events
        WINDOW c AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS ({_RUN} 1 PRECEDING))""",
    "mean_impute_prefix": f"SELECT event_id, round(coalesce(value, avg(value) OVER ({_RUN} CURRENT ROW), 0) + {NUDGE!r}::DOUBLE, 6) AS imputed FROM ({_BLANKED})",
    "mode_impute_prefix": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({_BLANKED})),
        m AS (SELECT q.event_id, r.event_type, count(*) AS n, min(r.rn) AS f FROM b q JOIN b r ON r.user_id = q.user_id AND r.rn < q.rn AND r.event_type IS NOT NULL WHERE q.event_type IS NULL GROUP BY q.event_id, r.event_type)
        SELECT b.event_id, coalesce(b.event_type, x.v) AS imputed FROM b LEFT JOIN (SELECT event_id, arg_min(event_type, (-n, f)) AS v FROM m GROUP BY event_id) x USING (event_id)""",
    "mode_impute_batch": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({_BLANKED})),
        m AS (SELECT user_id, event_type, count(*) AS n, min(rn) AS f FROM b WHERE event_type IS NOT NULL GROUP BY user_id, event_type)
        SELECT event_id, coalesce(event_type, v) AS imputed FROM b LEFT JOIN (SELECT user_id, arg_min(event_type, (-n, f)) AS v FROM m GROUP BY user_id) USING (user_id)""",
    "classification_metrics": f"""SELECT round(avg((p = t)::INTEGER::DOUBLE), 6) AS accuracy, {_SHARE("tp", "tp + fp")} AS precision, {_SHARE("tp", "tp + fn")} AS recall, {_SHARE("2 * tp", "2 * tp + fp + fn")} AS f1,
        {_SHARE("tn", "tn + fn")} AS precision_0, {_SHARE("tn", "tn + fp")} AS recall_0 FROM (
        SELECT p, t, count(*) FILTER (WHERE p = 1 AND t = 1) OVER () AS tp, count(*) FILTER (WHERE p = 1 AND t = 0) OVER () AS fp, count(*) FILTER (WHERE p = 0 AND t = 1) OVER () AS fn,
        count(*) FILTER (WHERE p = 0 AND t = 0) OVER () AS tn FROM (SELECT 1 - toxic AS p, quality AS t FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL)) GROUP BY tp, fp, fn, tn""",
    "regression_metrics": f"""SELECT l_returnflag, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(price) * count(*)), 6) AS r2
        FROM (SELECT *, quantity * 15 - price AS e FROM ({LINEITEM})) GROUP BY l_returnflag""",
    "running_accuracy": f"SELECT event_id, round(avg(((value > 60)::INTEGER = y)::INTEGER::DOUBLE) OVER ({_RUN} CURRENT ROW), 6) AS value FROM ({EVENTS})",
    "rolling_accuracy_100": f"SELECT event_id, round(avg(((value > 60)::INTEGER = y)::INTEGER::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS score FROM ({EVENTS})",
    "rolling_mae_100": "SELECT event_id, round(avg(abs(50.0::DOUBLE - value)) OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS score FROM events",
    "feature_union": _wide([_SD("a"), _SD("b"), _MM("a"), _MM("b")]),
    "column_transformer": _wide([_SD("a"), _MA("b")]),
    "gaussian_projection_score": _projected("OVER ()"),
    "gaussian_projection_prequential": _projected("OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "half_space_trees_score": f"""WITH e AS (SELECT event_id, x1, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM ({EVENTS})),
        l AS ({" UNION ALL ".join(f"SELECT event_id, n, {t} AS tree, {_leaf(t)} AS leaf FROM e" for t in range(FOREST.n_trees))}),
        c AS (SELECT tree, leaf, n // 250 AS w, count(*) AS r FROM l GROUP BY ALL),
        s AS (SELECT l.event_id, any_value(l.n) AS n, sum(coalesce(r, 0)) * 8.0 / 3 AS score FROM l LEFT JOIN c ON c.tree = l.tree AND c.leaf = l.leaf AND c.w = greatest((l.n - 1) // 250, 0) - 1 GROUP BY l.event_id)
        SELECT event_id, round(score::DOUBLE, 6) AS score, round(CASE WHEN n = 0 THEN 0.5 ELSE least(greatest(1 - score::DOUBLE / 2000.0, 0), 1) END, 6) AS score_one FROM s""",
}
