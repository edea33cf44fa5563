"""Sequential learners of each user's events, trees, ensembles, evaluation protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import EVENTS, NUDGE, ORDER, dimensions, events, lineitem, rounded
from ebbflow.functions.optimizers import Adam, Descent
from ebbflow.operators.anomaly import RandomCutForestApproximation
from ebbflow.operators.bayes import GaussianNB
from ebbflow.operators.cluster import StreamingKMeans
from ebbflow.operators.compose import DriftRetrainingWrapper, OnlinePipeline
from ebbflow.operators.drift import DDM
from ebbflow.operators.ensemble import Bagging, DriftAwareBagging, HighRatePoissonBagging
from ebbflow.operators.evaluate import holdout_score, interleaved_test_then_train, progressive_val_score
from ebbflow.operators.linear import LogisticRegression, PassiveAggressive, Perceptron
from ebbflow.operators.metrics import Accuracy
from ebbflow.operators.transform import StandardScaler
from ebbflow.operators.trees import ExtremelyFastTree, HoeffdingAdaptiveTree, HoeffdingTree

X = ["x1", "x2"]


def _weights(state):
    return state.select("user_id", "n", *[F.round(F.get("w", F.lit(i)), 6).alias(f"w{i + 1}") for i in range(2)], rounded("b"))


def _fit(op, native: bool = False):
    def run(spark, sf_dir):
        rows = events(spark, sf_dir)
        model = (op.fit_native if native else op.fit)(rows, X, "y", ORDER, "user_id")
        return _weights(model.state)

    return run


def kmeans_fit(spark, sf_dir):
    state = StreamingKMeans(2, 0.1).fit(events(spark, sf_dir), X, None, ORDER, "user_id").state
    rows = state.select("user_id", "n", F.posexplode(F.arrays_zip("centroids", "sizes")).alias("p", "c"))
    return rows.select("user_id", "n", (F.col("p") + 1).alias("cluster"), F.round(F.col("c.centroids")[0] + NUDGE, 6).alias("c1"), F.round(F.col("c.centroids")[1] + NUDGE, 6).alias("c2"), F.col("c.sizes").alias("size"))


def perceptron_prequential(spark, sf_dir):
    return Perceptron().prequential(events(spark, sf_dir), X, "y", ORDER, "user_id").select("event_id", "user_id", "y_pred")


def pipeline_scaler_perceptron_prequential(spark, sf_dir):
    op = OnlinePipeline(StandardScaler(), Perceptron())
    return op.prequential(events(spark, sf_dir), X, "y", ORDER, "user_id").select("event_id", "user_id", "y_pred")


def progressive_accuracy_trajectory(spark, sf_dir):
    scored = progressive_val_score(Perceptron(), events(spark, sf_dir), Accuracy(), X, "y", ORDER, "user_id", None)
    return scored.trajectory.select("event_id", "user_id", rounded("value"))


def progressive_accuracy_score(spark, sf_dir):
    scored = progressive_val_score(Perceptron(), events(spark, sf_dir), Accuracy(), X, "y", ORDER, "user_id", None)
    return scored.score.select("user_id", rounded("score"))


def holdout_accuracy(spark, sf_dir):
    out = holdout_score(Perceptron(), events(spark, sf_dir), Accuracy(), X, "y", ORDER, "user_id", train_size=30, test_size=20)
    return out.select("user_id", rounded("score"))


def interleaved_period_10(spark, sf_dir):
    scored = interleaved_test_then_train(Perceptron(), events(spark, sf_dir), Accuracy(), X, "y", ORDER, "user_id", None, 10)
    return scored.trajectory.select("event_id", "user_id", rounded("value"))


def drift_retraining_wrapper(spark, sf_dir):
    op = DriftRetrainingWrapper(Perceptron(), DDM(min_instances=5))
    return op.prequential(events(spark, sf_dir), X, "y", ORDER, "user_id").select("event_id", "user_id", "y_pred", "error", "status")


def _tree(op):
    """Order lines of each line number, in the order of shipment."""

    def run(spark, sf_dir):
        order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
        shown = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag"]
        out = op.prequential(lineitem(spark, sf_dir), ["quantity", "price", "discount", "tax"], "flag", order, "l_linenumber", keep=shown)
        return out.select(*shown, "y_pred")

    return run


def hoeffding_tree_nodes(spark, sf_dir):
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    return HoeffdingTree(split_criterion="gini").fit(lineitem(spark, sf_dir), ["quantity", "price", "discount", "tax"], "flag", order, "l_linenumber").nodes().select("l_linenumber", "id", "left", "right", "attribute", "depth", "n")


def rcf_scores(spark, sf_dir):
    op = RandomCutForestApproximation(n_trees=16, tree_size=64, seed=3, blocks=4)
    return op.fit_score(events(spark, sf_dir), X, ORDER, "event_type").select("event_id", "event_type", rounded("score"), "is_anomaly")


def _votes(op):
    def run(spark, sf_dir):
        rows, names = dimensions(spark, sf_dir, 64)
        return op.prequential(rows, names, "label", "vec_id").select("vec_id", "label", "y_pred")

    return run


def drift_aware_bagging_drifts(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, 64)
    return DriftAwareBagging(GaussianNB(), DDM(), 5, seed=2).fit(rows, names, "label", "vec_id").per_learner_drifts()


def _recursive(seed: str, step: str) -> str:
    return f"WITH RECURSIVE e AS ({EVENTS}), f AS (SELECT user_id, 0::BIGINT AS rn, {seed} FROM (SELECT DISTINCT user_id FROM e) UNION ALL {step})"


_NEXT = "FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1"
_START = "0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS b"
_Z = "f.w1 * e.x1 + f.w2 * e.x2 + f.b"
_WEIGHTS = " SELECT user_id, rn AS n, round(w1, 6) AS w1, round(w2, 6) AS w2, round(b, 6) AS b FROM f QUALIFY rn = max(rn) OVER (PARTITION BY user_id)"
_PERCEPTRON = _recursive(
    f"{_START}, 0::INTEGER AS said",
    f"""SELECT user_id, rn, w1 + r * x1, w2 + r * x2, b + r, CASE WHEN rn = 1 THEN 0 ELSE (z >= 0)::INTEGER END FROM (
        SELECT *, CASE WHEN (z >= 0) = (y > 0) THEN 0.0::DOUBLE WHEN y > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS r FROM (SELECT f.user_id, e.rn, e.x1, e.x2, e.y, f.w1, f.w2, f.b, {_Z} AS z {_NEXT}))""",
)


def _aggressive(tau: str) -> str:
    return _recursive(
        _START,
        f"""SELECT user_id, rn, w1 + r * x1, w2 + r * x2, b + r FROM (SELECT *, {tau} * t AS r FROM (SELECT *, greatest(0.0::DOUBLE, 1 - t * z) AS loss, x1 * x1 + x2 * x2 + 1 AS size FROM (
        SELECT f.user_id, e.rn, e.x1, e.x2, f.w1, f.w2, f.b, CASE WHEN e.y > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS t, {_Z} AS z {_NEXT})))""",
    )


_SGD = _recursive(
    _START,
    f"""SELECT user_id, rn, w1 - 0.1::DOUBLE * (g * x1 + 0.01::DOUBLE * w1), w2 - 0.1::DOUBLE * (g * x2 + 0.01::DOUBLE * w2), b - 0.1::DOUBLE * g FROM (
        SELECT f.user_id, e.rn, e.x1, e.x2, f.w1, f.w2, f.b, 1 / (1 + exp(-({_Z}))) - e.y AS g {_NEXT})""",
)


def _adam() -> str:
    names, grads = ["w1", "w2", "b"], ["g * x1", "g * x2", "g"]
    moments = ", ".join(f"0.9::DOUBLE * m{i} + (1 - 0.9::DOUBLE) * {g} AS m{i}_, 0.999::DOUBLE * v{i} + (1 - 0.999::DOUBLE) * ({g}) * ({g}) AS v{i}_" for i, g in enumerate(grads))
    moved = ", ".join(f"{w} - (m{i}_ / (1 - 0.9::DOUBLE ** rn)) / (sqrt(v{i}_ / (1 - 0.999::DOUBLE ** rn)) + 1e-8::DOUBLE) * 0.01::DOUBLE" for i, w in enumerate(names))
    carried = ", ".join(f"f.m{i}, f.v{i}" for i in range(3))
    return _recursive(
        _START + ", " + ", ".join(f"0::DOUBLE AS m{i}, 0::DOUBLE AS v{i}" for i in range(3)),
        f"""SELECT user_id, rn, {moved}, {", ".join(f"m{i}_, v{i}_" for i in range(3))} FROM (SELECT *, {moments} FROM (
        SELECT f.user_id, e.rn, e.x1, e.x2, f.w1, f.w2, f.b, {carried}, 1 / (1 + exp(-({_Z}))) - e.y AS g {_NEXT}))""",
    )


_KMEANS = (
    _recursive(
        "0::DOUBLE AS a1, 0::DOUBLE AS a2, 0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::BIGINT AS na, 0::BIGINT AS nb",
        f"""SELECT user_id, rn, CASE WHEN rn = 1 THEN x1 WHEN rn > 2 AND near THEN a1 - 0.1::DOUBLE * (a1 - x1) ELSE a1 END, CASE WHEN rn = 1 THEN x2 WHEN rn > 2 AND near THEN a2 - 0.1::DOUBLE * (a2 - x2) ELSE a2 END,
        CASE WHEN rn = 2 THEN x1 WHEN rn > 2 AND NOT near THEN b1 - 0.1::DOUBLE * (b1 - x1) ELSE b1 END, CASE WHEN rn = 2 THEN x2 WHEN rn > 2 AND NOT near THEN b2 - 0.1::DOUBLE * (b2 - x2) ELSE b2 END,
        (na + (rn = 1 OR (rn > 2 AND near))::INTEGER)::BIGINT, (nb + (rn = 2 OR (rn > 2 AND NOT near))::INTEGER)::BIGINT FROM (
        SELECT f.user_id, e.rn, e.x1, e.x2, f.a1, f.a2, f.b1, f.b2, f.na, f.nb, (f.a1 - e.x1) ** 2 + (f.a2 - e.x2) ** 2 <= (f.b1 - e.x1) ** 2 + (f.b2 - e.x2) ** 2 AS near {_NEXT})""",
    )
    + f""", l AS (SELECT * FROM f QUALIFY rn = max(rn) OVER (PARTITION BY user_id))
    SELECT user_id, rn AS n, 1::INTEGER AS cluster, round(a1 + {NUDGE!r}::DOUBLE, 6) AS c1, round(a2 + {NUDGE!r}::DOUBLE, 6) AS c2, na AS size FROM l WHERE rn >= 1
    UNION ALL SELECT user_id, rn, 2::INTEGER, round(b1 + {NUDGE!r}::DOUBLE, 6), round(b2 + {NUDGE!r}::DOUBLE, 6), nb FROM l WHERE rn >= 2"""
)
#: Features as scaled by the rows before (p) and by the rows up to each (q).
_SCALED = "SELECT *, " + ", ".join(
    f"CASE WHEN count({x}) OVER w{k} = 0 THEN {x} WHEN stddev_samp({x}) OVER w{k} > 0 THEN ({x} - avg({x}) OVER w{k}) / stddev_samp({x}) OVER w{k} ELSE 0 END AS {k}{i}" for k in "pq" for i, x in ((1, "x1"), (2, "x2"))
) + f""" FROM ({EVENTS}) WINDOW wp AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    wq AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_PIPELINE = f"""WITH RECURSIVE e AS ({_SCALED}), f AS (SELECT user_id, 0::BIGINT AS rn, {_START}, 0::INTEGER AS said FROM (SELECT DISTINCT user_id FROM e) UNION ALL
    SELECT user_id, rn, w1 + r * q1, w2 + r * q2, b + r, CASE WHEN rn = 1 THEN 0 ELSE (zp >= 0)::INTEGER END FROM (
      SELECT *, CASE WHEN (z >= 0) = (y > 0) THEN 0.0::DOUBLE WHEN y > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS r FROM (
        SELECT f.user_id, e.rn, e.q1, e.q2, e.y, f.w1, f.w2, f.b, f.w1 * e.p1 + f.w2 * e.p2 + f.b AS zp, f.w1 * e.q1 + f.w2 * e.q2 + f.b AS z {_NEXT})))"""
_WRAPPER = _recursive(
    f"{_START}, 0::BIGINT AS m, 0::BIGINT AS n, 0::BIGINT AS er, 'inf'::DOUBLE AS pm, 'inf'::DOUBLE AS sm, 0::INTEGER AS said, 0::INTEGER AS error, 0::INTEGER AS status",
    f"""SELECT user_id, rn, CASE WHEN st = 2 THEN 0 ELSE w1 + r * x1 END, CASE WHEN st = 2 THEN 0 ELSE w2 + r * x2 END, CASE WHEN st = 2 THEN 0 ELSE b + r END, (CASE WHEN st = 2 THEN 0 ELSE m + 1 END)::BIGINT,
      (CASE WHEN st = 2 THEN 0 ELSE n END)::BIGINT, (CASE WHEN st = 2 THEN 0 ELSE er END)::BIGINT, CASE WHEN st = 2 THEN 'inf'::DOUBLE ELSE p2 END, CASE WHEN st = 2 THEN 'inf'::DOUBLE ELSE s2 END, said, error, st FROM (
      SELECT *, (CASE WHEN n >= 5 AND p + s > p2 + 3.0::DOUBLE * s2 THEN 2 WHEN n >= 5 AND p + s > p2 + 2.0::DOUBLE * s2 THEN 1 ELSE 0 END)::INTEGER AS st FROM (
        SELECT *, CASE WHEN n >= 5 AND p + s < pm + sm THEN p ELSE pm END AS p2, CASE WHEN n >= 5 AND p + s < pm + sm THEN s ELSE sm END AS s2 FROM (
          SELECT *, sqrt(p * (1 - p) / n) AS s FROM (SELECT *, er::DOUBLE / n AS p FROM (
            SELECT *, er0 + error AS er FROM (SELECT *, (said <> y)::INTEGER AS error FROM (
              SELECT *, CASE WHEN m = 0 THEN 0 ELSE (z >= 0)::INTEGER END AS said, CASE WHEN (z >= 0) = (y > 0) THEN 0.0::DOUBLE WHEN y > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS r FROM (
                SELECT f.user_id, e.rn, e.x1, e.x2, e.y, f.w1, f.w2, f.b, f.m, f.n + 1 AS n, f.er AS er0, f.pm, f.sm, {_Z} AS z {_NEXT}))))))))""",
)
_SAID = " SELECT e.event_id, f.user_id, f.said AS y_pred FROM f JOIN e USING (user_id, rn)"

QUERIES = {
    "perceptron_fit": _fit(Perceptron()), "perceptron_fit_native": _fit(Perceptron(), True), "pa1_fit": _fit(PassiveAggressive(1.0, "pa1")), "pa2_fit": _fit(PassiveAggressive(1.0, "pa2"), True),
    "logistic_sgd_fit": _fit(LogisticRegression(Descent(0.1), l2=0.01)), "logistic_sgd_fit_native": _fit(LogisticRegression(Descent(0.1), l2=0.01), True),
    "logistic_adam_fit": _fit(LogisticRegression(Adam(0.01))), "logistic_adam_fit_native": _fit(LogisticRegression(Adam(0.01)), True), "kmeans_fit": kmeans_fit,
    "perceptron_prequential": perceptron_prequential, "pipeline_scaler_perceptron_prequential": pipeline_scaler_perceptron_prequential,
    "progressive_accuracy_trajectory": progressive_accuracy_trajectory, "progressive_accuracy_score": progressive_accuracy_score, "holdout_accuracy": holdout_accuracy,
    "interleaved_period_10": interleaved_period_10, "drift_retraining_wrapper": drift_retraining_wrapper, "hoeffding_tree_predict": _tree(HoeffdingTree()),
    "efdt_predict": _tree(ExtremelyFastTree()), "hat_predict": _tree(HoeffdingAdaptiveTree()), "hoeffding_tree_nodes": hoeffding_tree_nodes, "rcf_scores": rcf_scores,
    "bagging_predict": _votes(Bagging(GaussianNB(), 5, seed=2)), "high_rate_bagging_predict": _votes(HighRatePoissonBagging(GaussianNB(), 5, seed=2)),
    "drift_aware_bagging_predict": _votes(DriftAwareBagging(GaussianNB(), DDM(), 5, seed=2)), "drift_aware_bagging_drifts": drift_aware_bagging_drifts,
}
ORACLES = {
    "perceptron_fit": _PERCEPTRON + _WEIGHTS, "perceptron_fit_native": _PERCEPTRON + _WEIGHTS, "pa1_fit": _aggressive("least(1.0::DOUBLE, loss / size)") + _WEIGHTS,
    "pa2_fit": _aggressive("(loss / (size + 0.5::DOUBLE))") + _WEIGHTS, "logistic_sgd_fit": _SGD + _WEIGHTS, "logistic_sgd_fit_native": _SGD + _WEIGHTS,
    "logistic_adam_fit": _adam() + _WEIGHTS, "logistic_adam_fit_native": _adam() + _WEIGHTS, "kmeans_fit": _KMEANS, "perceptron_prequential": _PERCEPTRON + _SAID,
    "pipeline_scaler_perceptron_prequential": _PIPELINE + _SAID,
    "progressive_accuracy_trajectory": _PERCEPTRON + " SELECT e.event_id, f.user_id, round(avg((f.said = e.y)::INTEGER::DOUBLE) OVER (PARTITION BY f.user_id ORDER BY f.rn), 6) AS value FROM f JOIN e USING (user_id, rn) WHERE f.rn > 1",
    "progressive_accuracy_score": _PERCEPTRON + " SELECT f.user_id, round(coalesce(avg((f.said = e.y)::INTEGER::DOUBLE) FILTER (WHERE f.rn > 1), 'nan'::DOUBLE), 6) AS score FROM f JOIN e USING (user_id, rn) GROUP BY f.user_id",
    "holdout_accuracy": _PERCEPTRON + ", m AS (SELECT * FROM f WHERE rn <= 30 QUALIFY rn = max(rn) OVER (PARTITION BY user_id)) SELECT e.user_id, round(avg(((m.w1 * e.x1 + m.w2 * e.x2 + m.b >= 0)::INTEGER = e.y)::INTEGER::DOUBLE), 6) AS score FROM m JOIN e USING (user_id) WHERE e.rn BETWEEN 31 AND 50 GROUP BY e.user_id",
    "interleaved_period_10": _PERCEPTRON + " SELECT e.event_id, f.user_id, round((f.said = e.y)::INTEGER::DOUBLE, 6) AS value FROM f JOIN e USING (user_id, rn) WHERE f.rn > 1 AND f.rn % 10 = 0",
    "drift_retraining_wrapper": _WRAPPER + " SELECT e.event_id, f.user_id, f.said AS y_pred, f.error, f.status FROM f JOIN e USING (user_id, rn)",
}
