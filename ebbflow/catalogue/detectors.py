"""Change detectors over each user's error flags and values."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import EVENTS, ORDER, events, table
from ebbflow.operators.bayes import GaussianNB
from ebbflow.operators.drift import ADWIN, DDM, EDDM, KSWIN, PageHinkley
from ebbflow.operators.evaluate import progressive_val_score
from ebbflow.operators.metrics import Accuracy
from ebbflow.streaming.runner import running_totals, write_available

_DDM, _EDDM, _PH = DDM(min_instances=5), EDDM(min_instances=3), PageHinkley(min_instances=5, delta=0.005, threshold=100.0)


def _status(op, column):
    def run(spark, sf_dir):
        return op.prequential(events(spark, sf_dir), column, None, ORDER, "user_id").select("event_id", "user_id", "status")

    return run


def ddm_state(spark, sf_dir):
    """Final states, folded inside the JVM."""
    state = _DDM.fit_native(events(spark, sf_dir), "err", None, ORDER, "user_id").state
    return state.select("user_id", "n", "errors", "status", "drifts", "warnings")


def page_hinkley_state(spark, sf_dir):
    state = _PH.fit_native(events(spark, sf_dir), "value", None, ORDER, "user_id").state
    return state.select("user_id", "n", "drifts")


def eddm_state(spark, sf_dir):
    state = _EDDM.fit_native(events(spark, sf_dir), "err", None, ORDER, "user_id").state
    return state.select("user_id", "n", "n_errors", "drifts", "warnings")


def adwin_status(spark, sf_dir):
    return ADWIN(0.05).prequential(events(spark, sf_dir), "value", None, ORDER, "event_type").select("event_id", "event_type", "status")


def kswin_fold_status(spark, sf_dir):
    return KSWIN(0.05, 60, 20).prequential(events(spark, sf_dir), "value", None, ORDER, "event_type").select("event_id", "event_type", "status")


def _shared_folder(spark) -> str:
    """Where a streaming query keeps its offsets, state and output."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ebbflow-stream-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumns({"err": (F.col("event_type") == "error").cast("int")})


def streaming_ddm_status(spark, sf_dir):
    """The DDM query over a stream: state in RocksDB, output in Parquet."""
    folder = _shared_folder(spark)
    rows = _event_stream(spark, sf_dir).select("event_id", "ts", "user_id", "err")
    out = _DDM.stream(rows, "err", None, ORDER, "user_id")
    write_available(out.select("event_id", "user_id", "status"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def streaming_user_totals(spark, sf_dir):
    """A mergeable operator over a stream: error rates of users, by a streaming aggregation."""
    folder = _shared_folder(spark)
    totals = running_totals(_event_stream(spark, sf_dir), [F.count("*").alias("n"), F.sum("err").alias("errors")], ["user_id"])

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def naive_bayes_trajectory(spark, sf_dir):
    """Test-then-train accuracy of a Gaussian model of each user."""
    scored = progressive_val_score(GaussianNB(), events(spark, sf_dir), Accuracy(), ["x1", "x2"], "y", ORDER, "user_id", None)
    return scored.score.select("user_id", F.round("score", 6).alias("score"))


def _recursive(seed: str, step: str, out: str) -> str:
    return f"WITH RECURSIVE e AS ({EVENTS}), f AS (SELECT user_id, 0::BIGINT AS rn, {seed} FROM (SELECT DISTINCT user_id FROM e) UNION ALL {step}) {out}"


_DDM_SQL = _recursive(
    "0::BIGINT AS n, 0::BIGINT AS er, 'inf'::DOUBLE AS pm, 'inf'::DOUBLE AS sm, 0::INTEGER AS status, 0::BIGINT AS drifts, 0::BIGINT AS warnings",
    """SELECT user_id, rn, (CASE WHEN st = 2 THEN 0 ELSE n END)::BIGINT, (CASE WHEN st = 2 THEN 0 ELSE er END)::BIGINT, CASE WHEN st = 2 THEN 'inf'::DOUBLE ELSE p2 END,
        CASE WHEN st = 2 THEN 'inf'::DOUBLE ELSE s2 END, st, (drifts + (st = 2)::INTEGER)::BIGINT, (warnings + (st = 1)::INTEGER)::BIGINT FROM (
      SELECT *, (CASE WHEN n >= 5 AND p + s > p2 + 3.0::DOUBLE * s2 THEN 2 WHEN n >= 5 AND p + s > p2 + 2.0::DOUBLE * s2 THEN 1 ELSE 0 END)::INTEGER AS st FROM (
        SELECT *, CASE WHEN n >= 5 AND p + s < pm + sm THEN p ELSE pm END AS p2, CASE WHEN n >= 5 AND p + s < pm + sm THEN s ELSE sm END AS s2 FROM (
          SELECT *, sqrt(p * (1 - p) / n) AS s FROM (SELECT *, er::DOUBLE / n AS p FROM (
            SELECT f.user_id, e.rn, f.n + 1 AS n, f.er + e.err AS er, f.pm, f.sm, f.drifts, f.warnings FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))))""",
    "",
)
_EDDM_SQL = _recursive(
    """0::BIGINT AS n, 0::BIGINT AS ne, 0::BIGINT AS le, 0::DOUBLE AS mean, 0::DOUBLE AS sd, 0::DOUBLE AS mm, 0::DOUBLE AS sm, 0::INTEGER AS status, 0::BIGINT AS drifts, 0::BIGINT AS warnings""",
    """SELECT user_id, rn, (CASE WHEN st = 2 THEN 0 ELSE n END)::BIGINT, (CASE WHEN st = 2 THEN 0 ELSE ne END)::BIGINT, (CASE WHEN st = 2 THEN 0 ELSE le END)::BIGINT,
        CASE WHEN st = 2 THEN 0::DOUBLE ELSE mean END, CASE WHEN st = 2 THEN 0::DOUBLE ELSE sd END, CASE WHEN st = 2 THEN 0::DOUBLE ELSE mm END, CASE WHEN st = 2 THEN 0::DOUBLE ELSE sm END, st,
        (drifts + (st = 2)::INTEGER)::BIGINT, (warnings + (st = 1)::INTEGER)::BIGINT FROM (
      SELECT *, (CASE WHEN NOT due OR mm + 2 * sm <= 0 THEN 0 WHEN (mean + 2 * sd) / (mm + 2 * sm) < 0.9::DOUBLE THEN 2 WHEN (mean + 2 * sd) / (mm + 2 * sm) < 0.95::DOUBLE THEN 1 ELSE 0 END)::INTEGER AS st FROM (
        SELECT user_id, rn, n, ne, le, mean, sd, due, drifts, warnings, CASE WHEN due AND mean + 2 * sd > m0 + 2 * s0 THEN mean ELSE m0 END AS mm, CASE WHEN due AND mean + 2 * sd > m0 + 2 * s0 THEN sd ELSE s0 END AS sm FROM (
          SELECT *, err = 1 AND ne >= 3 AS due, CASE WHEN err = 1 AND ne > 1 THEN sqrt(greatest((CASE WHEN ne > 2 THEN sd1 * sd1 * (ne - 2) ELSE 0 END + (gap - mean1) * (gap - mean)) / (ne - 1), 0)) ELSE sd1 END AS sd FROM (
            SELECT *, CASE WHEN err = 1 AND ne > 1 THEN mean1 + (gap - mean1) / (ne - 1) ELSE mean1 END AS mean FROM (
              SELECT f.user_id, e.rn, e.err, f.n + 1 AS n, f.ne + e.err AS ne, CASE WHEN e.err = 1 THEN f.n + 1 ELSE f.le END AS le, (f.n + 1 - f.le)::DOUBLE AS gap, f.mean AS mean1, f.sd AS sd1, f.mm AS m0, f.sm AS s0, f.drifts, f.warnings
              FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))))""",
    "",
)
_PH_SQL = _recursive(
    "0::BIGINT AS n, 0::DOUBLE AS xm, 0::DOUBLE AS t, 0::DOUBLE AS l, 0::INTEGER AS status, 0::BIGINT AS drifts",
    """SELECT user_id, rn, (CASE WHEN st = 2 THEN 0 ELSE n END)::BIGINT, CASE WHEN st = 2 THEN 0::DOUBLE ELSE xm END, CASE WHEN st = 2 THEN 0::DOUBLE ELSE t END, CASE WHEN st = 2 THEN 0::DOUBLE ELSE l END, st,
        (drifts + (st = 2)::INTEGER)::BIGINT FROM (
      SELECT *, (CASE WHEN n >= 5 AND t - l > 100.0::DOUBLE THEN 2 ELSE 0 END)::INTEGER AS st FROM (SELECT *, least(l0, t) AS l FROM (SELECT *, t0 + (value - xm - 0.005::DOUBLE) AS t FROM (
        SELECT f.user_id, e.rn, e.value, f.n + 1 AS n, CASE WHEN f.n = 0 THEN e.value ELSE 0.9999::DOUBLE * f.xm + (1 - 0.9999::DOUBLE) * e.value END AS xm, f.t AS t0, f.l AS l0, f.drifts
        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))))""",
    "",
)


def _bayes_sql() -> str:
    """Scores of both classes from the rows before each; a class that was not seen has none."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    stats = ", ".join(
        f"count(*) FILTER (WHERE y = {c}) {w} AS n{c}, " + ", ".join(f"avg({x}) FILTER (WHERE y = {c}) {w} AS m{c}{x}, var_samp({x}) FILTER (WHERE y = {c}) {w} AS v{c}{x}" for x in ("x1", "x2")) for c in (0, 1)
    )
    term = lambda c, x: f"CASE WHEN v{c}{x} > 0 THEN -0.5 * (ln(2 * pi() * v{c}{x}) + ({x} - m{c}{x}) ** 2 / v{c}{x}) ELSE 0 END"
    score = lambda c: f"CASE WHEN n{c} > 0 THEN ln(n{c}::DOUBLE / (n0 + n1)) + {term(c, 'x1')} + {term(c, 'x2')} END AS s{c}"
    return f"""SELECT user_id, round(coalesce(avg((said = y)::INTEGER::DOUBLE) FILTER (WHERE rn > 1), 'nan'::DOUBLE), 6) AS score FROM (
        SELECT *, CASE WHEN s0 IS NULL THEN 1 WHEN s1 IS NULL OR s0 >= s1 THEN 0 ELSE 1 END AS said FROM (SELECT *, {score(0)}, {score(1)} FROM (SELECT *, {stats} FROM ({EVENTS})))) GROUP BY user_id"""


_ROWS = "SELECT e.event_id, f.user_id, f.status FROM f JOIN e USING (user_id, rn)"
_LAST = lambda columns: f"SELECT user_id, {columns} FROM f QUALIFY rn = max(rn) OVER (PARTITION BY user_id)"

QUERIES = {
    "ddm_status": _status(_DDM, "err"), "eddm_status": _status(_EDDM, "err"), "page_hinkley_status": _status(_PH, "value"), "ddm_state": ddm_state, "eddm_state": eddm_state,
    "page_hinkley_state": page_hinkley_state, "adwin_status": adwin_status, "kswin_fold_status": kswin_fold_status, "streaming_ddm_status": streaming_ddm_status,
    "streaming_user_totals": streaming_user_totals, "naive_bayes_trajectory": naive_bayes_trajectory,
}
from ebbflow.catalogue.windows import ORACLES as _WINDOWS  # noqa: E402

ORACLES = {
    "ddm_status": _DDM_SQL + _ROWS, "eddm_status": _EDDM_SQL + _ROWS, "page_hinkley_status": _PH_SQL + _ROWS, "streaming_ddm_status": _DDM_SQL + _ROWS,
    "ddm_state": _DDM_SQL + _LAST("n, er AS errors, status, drifts, warnings"), "eddm_state": _EDDM_SQL + _LAST("n, ne AS n_errors, drifts, warnings"), "page_hinkley_state": _PH_SQL + _LAST("n, drifts"),
    "naive_bayes_trajectory": _bayes_sql(),
    "kswin_fold_status": _WINDOWS["kswin_status"],
    "streaming_user_totals": "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id",
}
