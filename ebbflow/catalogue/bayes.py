"""Naive Bayes queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.shared import LINEITEM, dimensions, dimensions_sql, lineitem, rounded, table
from ebbflow.operators.bayes import BernoulliNB, GaussianNB, MultinomialNB
from ebbflow.operators.metrics import Accuracy

D = 64
LETTERS = "aeinorst"


def gaussian_nb_predict(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, D)
    out = GaussianNB().fit(rows, names, "label").predict(rows)
    return out.select("vec_id", "y_pred", F.explode("proba").alias("class", "prob")).select("vec_id", "y_pred", "class", rounded("prob"))


def gaussian_nb_fit(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, D)
    parts = GaussianNB().fit(rows, names, "label").by_class()
    return parts.select("label", "n", "feature", rounded("mean"), F.round(F.col("m2") / (F.col("n") - 1), 6).alias("variance"))


def gaussian_nb_accuracy(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, D)
    out = GaussianNB().fit(rows, names, "label").predict(rows)
    return Accuracy().score(out, "y_pred", "label", name="accuracy").select(rounded("accuracy"))


def gaussian_nb_merge(spark, sf_dir):
    rows, names = dimensions(spark, sf_dir, D)
    halves = [GaussianNB().fit(rows.where(F.col("vec_id") % 2 == k), names, "label") for k in (0, 1)]
    parts = halves[0].merge(halves[1]).by_class()
    return parts.select("label", "n", "feature", rounded("mean"), F.round(F.col("m2") / (F.col("n") - 1), 6).alias("variance"))


def _signs(spark, sf_dir):
    return lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "flag", (F.col("quantity") - 2.5).alias("b0"), (F.col("discount") - 0.05).alias("b1"),
        (F.col("tax") - 0.04).alias("b2"), (F.col("price") - 30).alias("b3"),
    )


def bernoulli_nb_predict(spark, sf_dir):
    rows = _signs(spark, sf_dir)
    out = BernoulliNB().fit(rows, ["b0", "b1", "b2", "b3"], "flag").predict(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "y_pred", F.round(F.col("proba")[1], 6).alias("p1"))


def _letters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", *[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias(f"n_{c}") for c in LETTERS])


def multinomial_nb_predict(spark, sf_dir):
    rows = _letters(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    names = [f"n_{c}" for c in LETTERS]
    out = MultinomialNB().fit(rows.join(labels, "doc_id"), names, "quality").predict(rows)
    return out.select("doc_id", "y_pred", F.round(F.col("proba")[1], 6).alias("p1"))


def class_prior(spark, sf_dir):
    model = GaussianNB().fit(lineitem(spark, sf_dir), ["quantity"], "flag")
    return model.class_prior().select("label", rounded("prior"))


_GAUSS = f"""d AS ({dimensions_sql(D)}), long AS (SELECT vec_id, label, f, x FROM d, LATERAL (SELECT unnest(range({D})) AS f, unnest([{", ".join(f"e{i}" for i in range(D))}]) AS x)),
  m AS (SELECT label, f, count(*) AS n, avg(x) AS mu, var_samp(x) AS v FROM long GROUP BY label, f), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY label),
  s AS (SELECT l.vec_id, c.label AS class, ln(any_value(c.n)::DOUBLE / any_value(c.total)) + sum(CASE WHEN m.v > 0 THEN -0.5 * (ln(2 * pi() * m.v) + (l.x - m.mu) ** 2 / m.v) ELSE 0 END) AS s
    FROM long l JOIN m ON m.f = l.f JOIN c ON c.label = m.label GROUP BY l.vec_id, c.label),
  e AS (SELECT vec_id, class, s, exp(s - max(s) OVER (PARTITION BY vec_id)) AS g FROM s),
  p AS (SELECT vec_id, class, g / sum(g) OVER (PARTITION BY vec_id) AS prob, first_value(class) OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS y_pred FROM e)"""
_MOMENTS = f"WITH {_GAUSS} SELECT label, n::BIGINT AS n, f::INTEGER AS feature, round(mu, 6) AS mean, round(v, 6) AS variance FROM m"


_B = ["b0", "b1", "b2", "b3"]
_BERNOULLI = f"""WITH r AS (SELECT *, quantity - 2.5 AS b0, discount - 0.05 AS b1, tax - 0.04 AS b2, price - 30 AS b3 FROM ({LINEITEM})),
  c AS (SELECT flag AS class, count(*) AS n, sum(count(*)) OVER () AS total, {", ".join(f"count(*) FILTER (WHERE {b} > 0) AS k{i}" for i, b in enumerate(_B))} FROM r GROUP BY flag),
  t AS (SELECT class, ln(n::DOUBLE / total) AS prior, {", ".join(f"(k{i} + 1)::DOUBLE / (n + 2) AS p{i}" for i in range(4))} FROM c),
  s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, list({{'s': prior + {" + ".join(f"CASE WHEN {b} > 0 THEN ln(p{i}) ELSE ln(1 - p{i}) END" for i, b in enumerate(_B))}, 'c': class}} ORDER BY class) AS l
    FROM (SELECT *, row_number() OVER () AS rid FROM r), t GROUP BY rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice),
  m AS (SELECT *, list_max(list_transform(l, lambda v: v.s)) AS top FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, list_filter(l, lambda v: v.s = top)[1].c::INTEGER AS y_pred,
  round(exp(l[2].s - top) / list_sum(list_transform(l, lambda v: exp(v.s - top))), 6) AS p1 FROM m"""
_N = [f"n_{c}" for c in LETTERS]
_MULTINOMIAL = f"""WITH r AS (SELECT doc_id, {", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE AS n_{c}" for c in LETTERS)} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
  c AS (SELECT quality AS class, count(*) AS n, sum(count(*)) OVER () AS total, {", ".join(f"sum({n}) AS t{i}" for i, n in enumerate(_N))} FROM r JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality),
  t AS (SELECT class, ln(n::DOUBLE / total) AS prior, {", ".join(f"ln((t{i} + 1) / ({' + '.join(f't{k}' for k in range(len(_N)))} + {len(_N)})) AS l{i}" for i in range(len(_N)))} FROM c),
  s AS (SELECT doc_id, list({{'s': prior + {" + ".join(f"{n} * l{i}" for i, n in enumerate(_N))}, 'c': class}} ORDER BY class) AS l FROM r, t GROUP BY doc_id, {", ".join(_N)}),
  m AS (SELECT *, list_max(list_transform(l, lambda v: v.s)) AS top FROM s)
SELECT doc_id, list_filter(l, lambda v: v.s = top)[1].c::INTEGER AS y_pred, round(exp(l[2].s - top) / list_sum(list_transform(l, lambda v: exp(v.s - top))), 6) AS p1 FROM m"""

QUERIES = {
    "gaussian_nb_predict": gaussian_nb_predict, "gaussian_nb_fit": gaussian_nb_fit, "gaussian_nb_accuracy": gaussian_nb_accuracy, "gaussian_nb_merge": gaussian_nb_merge,
    "bernoulli_nb_predict": bernoulli_nb_predict, "multinomial_nb_predict": multinomial_nb_predict, "class_prior": class_prior,
}
ORACLES = {
    "gaussian_nb_predict": f"WITH {_GAUSS} SELECT vec_id, y_pred::INTEGER AS y_pred, class::INTEGER AS class, round(prob, 6) AS prob FROM p",
    "gaussian_nb_fit": _MOMENTS,
    "gaussian_nb_accuracy": f"WITH {_GAUSS} SELECT round(avg((y_pred = d.label)::INTEGER::DOUBLE), 6) AS accuracy FROM d JOIN (SELECT DISTINCT vec_id, y_pred FROM p) USING (vec_id)",
    "gaussian_nb_merge": _MOMENTS,
    "bernoulli_nb_predict": _BERNOULLI,
    "multinomial_nb_predict": _MULTINOMIAL,
    "class_prior": f"SELECT flag::INTEGER AS label, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS prior FROM ({LINEITEM}) GROUP BY flag",
}
