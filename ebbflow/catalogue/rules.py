"""Update rules, resampling ensembles and adaptive windows, each with recursive or windowed SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.hashing import hash_sql, poisson_sql
from ebbflow.catalogue.learners import _NEXT, _START, _WEIGHTS, _Z, _fit, _recursive
from ebbflow.catalogue.shared import ORDER, dimensions_sql, events
from ebbflow.functions import optimizers as O
from ebbflow.operators.drift import ADWIN
from ebbflow.operators.linear import LogisticRegression

RULES = {
    "momentum": O.Momentum(0.05), "nesterov": O.Nesterov(0.05), "adagrad": O.AdaGrad(0.1), "rmsprop": O.RMSProp(0.01), "adamw": O.AdamW(0.01, decay=0.1), "radam": O.RAdam(0.01),
    "nadam": O.NAdam(0.01), "adamax": O.AdaMax(0.01), "oadam": O.OAdam(0.01),
}
_REAL = lambda v: f"{float(v)!r}::DOUBLE"
#: By rule: slots with initial values, their new values and what is taken off, for gradient ``{g}``, value ``{w}``, old slots ``{m} {v} {a} {u}`` and new ones ``{M} {V} {A} {U}``.
_ADAM = ({"m": 0.0, "v": 0.0}, {"m": "0.9::DOUBLE * {m} + (1 - 0.9::DOUBLE) * {g}", "v": "0.999::DOUBLE * {v} + (1 - 0.999::DOUBLE) * {g} * {g}"})
_STEP = "({M} / (1 - 0.9::DOUBLE ** rn)) / (sqrt({V} / (1 - 0.999::DOUBLE ** rn)) + 1e-8::DOUBLE) * 0.01::DOUBLE"
_LENGTH = "(1999.0::DOUBLE - 0.999::DOUBLE ** rn * rn * 2 / (1 - 0.999::DOUBLE ** rn))"
_FORMULAS = {
    "momentum": ({"v": 0.0}, {"v": "0.9::DOUBLE * {v} + 0.05::DOUBLE * {g}"}, "{V}"),
    "nesterov": ({"v": 0.0}, {"v": "0.9::DOUBLE * {v} - 0.05::DOUBLE * {g}"}, "({g} * (1.9::DOUBLE * 0.05::DOUBLE) - {v} * 0.81::DOUBLE)"),
    "adagrad": ({"a": 1e-8}, {"a": "{a} + {g} * {g}"}, "{g} * 0.1::DOUBLE / (sqrt({A}) + 1e-8::DOUBLE)"),
    "rmsprop": ({"a": 0.0}, {"a": "0.9::DOUBLE * {a} + (1 - 0.9::DOUBLE) * {g} * {g}"}, "{g} * 0.01::DOUBLE / (sqrt({A}) + 1e-8::DOUBLE)"),
    "adamw": (*_ADAM, f"({_STEP} + {{w}} * (0.01::DOUBLE * 0.1::DOUBLE))"),
    "radam": (
        *_ADAM,
        f"""CASE WHEN {_LENGTH} > 4 THEN ({{M}} / (1 - 0.9::DOUBLE ** rn)) * sqrt(({_LENGTH} - 4) * ({_LENGTH} - 2) * 1999 / ({_LENGTH} * (1995.0::DOUBLE * 1997)))
            / (sqrt({{V}} / (1 - 0.999::DOUBLE ** rn)) + 1e-8::DOUBLE) * 0.01::DOUBLE ELSE ({{M}} / (1 - 0.9::DOUBLE ** rn)) * 0.01::DOUBLE END""",
    ),
    "nadam": (
        *_ADAM,
        "(0.9::DOUBLE * {M} / (1 - 0.9::DOUBLE ** (rn + 1)) + {g} * (1 - 0.9::DOUBLE) / (1 - 0.9::DOUBLE ** rn)) / (sqrt({V} * 0.999::DOUBLE / (1 - 0.999::DOUBLE ** rn)) + 1e-8::DOUBLE) * 0.01::DOUBLE",
    ),
    "adamax": ({"m": 0.0, "v": 0.0}, {"m": _ADAM[1]["m"], "v": "greatest(0.999::DOUBLE * {v}, abs({g}))"}, "({M} / (1 - 0.9::DOUBLE ** rn)) / ({V} + 1e-8::DOUBLE) * 0.01::DOUBLE"),
    "oadam": (
        {"m": 0.0, "v": 0.0, "u": 0.0},
        {
            "m": "0.5::DOUBLE * {m} + (1 - 0.5::DOUBLE) * {g}", "v": "0.9::DOUBLE * {v} + (1 - 0.9::DOUBLE) * {g} * {g}",
            "u": "((0.5::DOUBLE * {m} + 0.5::DOUBLE * {g}) / (1 - 0.5::DOUBLE ** rn)) / (sqrt((0.9::DOUBLE * {v} + (1 - 0.9::DOUBLE) * {g} * {g}) / (1 - 0.9::DOUBLE ** rn)) + 1e-8::DOUBLE) * 0.01::DOUBLE",
        },
        "(2 * {U} - {u})",
    ),
}


def _rule_sql(name: str) -> str:
    slots, moved, taken = _FORMULAS[name]
    names, grads = ["w1", "w2", "b"], ["(g * x1)", "(g * x2)", "g"]

    def filled(text: str, i: int) -> str:
        held = {s: f"{s}{i}" for s in slots} | {s.upper(): f"n{s}{i}" for s in slots}
        return text.format(g=grads[i], w=names[i], **held)

    every = [(s, i) for i in range(3) for s in slots]
    new = ", ".join(f"{filled(moved[s], i)} AS n{s}{i}" for s, i in every)
    weights = ", ".join(f"{w} - {filled(taken, i)}" for i, w in enumerate(names))
    return _recursive(
        _START + ", " + ", ".join(f"{_REAL(slots[s])} AS {s}{i}" for s, i in every),
        f"""SELECT user_id, rn, {weights}, {", ".join(f"n{s}{i}" for s, i in every)} FROM (SELECT *, {new} FROM (
        SELECT f.user_id, e.rn, e.x1, e.x2, f.w1, f.w2, f.b, {", ".join(f"f.{s}{i}" for s, i in every)}, 1 / (1 + exp(-({_Z}))) - e.y AS g {_NEXT}))""",
    ) + _WEIGHTS


def _bagging_sql(rate: float, seed: int, members: int, d: int = 64) -> str:
    """Each member's Gaussian scores from the rows before, counted as often as it drew them; then the vote."""
    return f"""WITH d AS ({dimensions_sql(d)}), r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, {hash_sql("vec_id")} AS h FROM d),
  k AS (SELECT rn, m, label, {poisson_sql(rate, seed, "m", "h")} AS k FROM r, (SELECT unnest(range({members})) AS m)),
  x AS (SELECT rn, f, x FROM (SELECT row_number() OVER (ORDER BY vec_id) AS rn, [{", ".join(f"e{i}" for i in range(d))}] AS xs FROM d), LATERAL (SELECT unnest(range({d})) AS f, unnest(xs) AS x)),
  g AS (SELECT k.rn, k.m, c.c, x.f, x.x, CASE WHEN k.label = c.c THEN k.k ELSE 0 END AS k FROM k JOIN x USING (rn), (SELECT DISTINCT label AS c FROM d) AS c),
  t AS (SELECT rn, m, c, x, sum(k) OVER w AS n, sum(k * x) OVER w AS s, sum(k * x * x) OVER w AS q, count(*) FILTER (WHERE k > 0) OVER w AS rows FROM g
    WINDOW w AS (PARTITION BY m, c, f ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  v AS (SELECT *, s / n AS mu, CASE WHEN rows > 1 THEN (q - s * s / n) / (n - 1) END AS var FROM t WHERE n > 0),
  l AS (SELECT rn, m, c, any_value(n) AS n, sum(CASE WHEN var > 0 THEN -0.5 * (ln(2 * pi() * var) + (x - mu) ** 2 / var) ELSE 0 END) AS ll FROM v GROUP BY rn, m, c),
  p AS (SELECT rn, m, c, ln(n::DOUBLE / sum(n) OVER (PARTITION BY rn, m)) + ll AS s FROM l),
  b AS (SELECT rn, m, arg_min(c, (-s, c)) AS y FROM p GROUP BY rn, m),
  votes AS (SELECT k.rn, coalesce(b.y, 0) AS y, count(*) AS n FROM k LEFT JOIN b USING (rn, m) GROUP BY k.rn, coalesce(b.y, 0)),
  best AS (SELECT rn, arg_min(y, (-n, y)) AS y_pred FROM votes GROUP BY rn)
  SELECT vec_id, label, y_pred::INTEGER AS y_pred FROM r JOIN best USING (rn)"""


#: Every other stretch of 60 rows of a type lies higher, so windows are cut.
SHIFT = 60


def adwin_shift_status(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("value", F.col("x1") + F.when(F.floor(F.col("event_id") / (5 * SHIFT)) % 2 == 1, 4.0).otherwise(0.0))
    return ADWIN(0.05).prequential(rows, "value", None, ORDER, "event_type").select("event_id", "event_type", "status")


def _adwin_sql(value: str) -> str:
    """The window as prefix sums ``s`` and ``q`` of values and squares; a step takes a row in, cuts once, or finds that no cut is left."""
    log_term = "ln(2 * ln(n) / 0.05::DOUBLE)"
    gap = "abs(s[i + 1] / i - (s[n + 1] - s[i + 1]) / (n - i))"
    inverse = "(1.0::DOUBLE / i + 1.0::DOUBLE / (n - i))"
    return f"""WITH RECURSIVE e AS (SELECT event_id, event_type, {value} AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
  f AS (SELECT DISTINCT event_type, 0::BIGINT AS rn, [0.0::DOUBLE] AS s, [0.0::DOUBLE] AS q, FALSE AS cut, FALSE AS open FROM e
    UNION ALL (
      WITH o AS (SELECT *, len(s) - 1 AS n FROM f WHERE open),
        a AS (SELECT *, CASE WHEN n < 10 THEN NULL ELSE sqrt(2 * greatest((q[n + 1] - s[n + 1] * s[n + 1] / n) / (n - 1), 0) * {log_term}) END AS a, CASE WHEN n < 10 THEN NULL ELSE 2.0::DOUBLE / 3 * {log_term} END AS b FROM o),
        c AS (SELECT *, CASE WHEN n < 10 THEN NULL ELSE list_filter(range(5, n - 4), lambda i: {gap} > a * sqrt({inverse}) + b * {inverse})[1] END AS place FROM a)
      SELECT event_type, rn, CASE WHEN place IS NULL THEN s ELSE list_transform(s[place + 1:], lambda z: z - s[place + 1]) END, CASE WHEN place IS NULL THEN q ELSE list_transform(q[place + 1:], lambda z: z - q[place + 1]) END,
        cut OR place IS NOT NULL, place IS NOT NULL FROM c
      UNION ALL SELECT f.event_type, e.rn, list_append(s, s[-1] + e.v), list_append(q, q[-1] + e.v * e.v), FALSE, TRUE FROM f JOIN e ON e.event_type = f.event_type AND e.rn = f.rn + 1 WHERE NOT f.open))
  SELECT e.event_id, f.event_type, (CASE WHEN f.cut THEN 2 ELSE 0 END)::INTEGER AS status FROM f JOIN e USING (event_type, rn) WHERE NOT f.open"""


QUERIES = {f"logistic_{name}_fit": _fit(LogisticRegression(rule)) for name, rule in RULES.items()} | {
    "adwin_shift_status": adwin_shift_status,
}
ORACLES = {f"logistic_{name}_fit": _rule_sql(name) for name in RULES} | {
    "adwin_shift_status": _adwin_sql(f"value / 100 + CASE WHEN event_id // {5 * SHIFT} % 2 = 1 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END"), "adwin_status": _adwin_sql("value"),
    "bagging_predict": _bagging_sql(1.0, 2, 5), "high_rate_bagging_predict": _bagging_sql(6.0, 2, 5),
}
