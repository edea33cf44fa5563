"""Generator rules on given attributes, and generators themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.catalogue.hashing import normal_sql, uniform_sql
from ebbflow.catalogue.shared import table
from ebbflow.sources.generators import LED_SEGMENTS, SEA_THRESHOLDS, AgrawalGenerator, ConceptDriftStream, HyperplaneGenerator, LEDGenerator, RandomRBFGenerator, SEAGenerator, SineGenerator, agrawal_label, led_pattern, sea_label
from ebbflow.streaming.source import register


def sea_labels(spark, sf_dir):
    """All four concepts on line items."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") / 5).alias("a"), (F.col("l_tax") * 50).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[sea_label(k, F.col("a"), F.col("b")).alias(f"y{k}") for k in range(1, 5)])


def agrawal_labels(spark, sf_dir):
    """All ten predicates on attributes made from customers."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.lit(75_000.0) + F.col("c_acctbal") * 5).alias("salary"), (key % 61 + 20).cast("double").alias("age"), (key % 5).cast("double").alias("elevel"), (key % 20 + 1).cast("double").alias("car"),
        (50_000.0 + key % 450 * 1000.0).alias("hvalue"), (key % 30 + 1).cast("double").alias("hyears"), (key % 500 * 1000.0).alias("loan"),
    )
    c = {n: F.col(n) for n in ("salary", "age", "elevel", "car", "hvalue", "hyears", "loan")}
    return rows.select("c_custkey", *[agrawal_label(k, **c).alias(f"y{k}") for k in range(1, 11)])


def led_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).cast("int").alias("digit"))
    return rows.select("p_partkey", "digit", F.posexplode(led_pattern(F.col("digit"))).alias("segment", "lit"))


ROWS = 2000
SINE, RBF, LED, AGRAWAL, SEA = SineGenerator(), RandomRBFGenerator(), LEDGenerator(), AgrawalGenerator(3), SEAGenerator(2)
PLANE, TURNING = HyperplaneGenerator(), HyperplaneGenerator(mag_change=0.01)
DRIFTING = ConceptDriftStream(RandomRBFGenerator(n_features=3, n_centroids=5), 100)


def _generated(generator):
    """``seq``, each attribute and ``y`` of the first rows."""

    def run(spark, sf_dir):
        rows = generator.frame(spark, ROWS)
        d = rows.select(F.size("x")).first()[0]
        return rows.select("seq", *[F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(d)], F.round("y", 6).alias("y"))

    return run


def _stream_sql(x: list[str], y: str, rows: str | None = None) -> str:
    """Attributes and target by row number."""
    given = rows or f"SELECT unnest(range(1, {ROWS + 1})) AS seq"
    return f"SELECT seq, {', '.join(f'round(({v})::DOUBLE, 6) AS x{i}' for i, v in enumerate(x))}, round({y}, 6) AS y FROM ({given})"


def _either(draw: str, noise: float) -> str:
    """The label ``y``, turned over where a draw is below ``noise``."""
    return f"CASE WHEN {draw} < {noise!r}::DOUBLE THEN 1 - label ELSE label END"


def _rbf_sql() -> str:
    places, classes, weights = RBF.centroids()
    chosen = " ".join(f"WHEN u < {float(w)!r}::DOUBLE THEN {k}" for k, w in enumerate(weights[:-1], 1))
    rows = f"SELECT seq, CASE {chosen} ELSE {len(weights)} END AS chosen FROM (SELECT seq, {uniform_sql(1, 'seq', -1)} AS u FROM (SELECT unnest(range(1, {ROWS + 1})) AS seq))"
    x = [f"{[float(v) for v in places[:, j]]}[chosen] + 0.1::DOUBLE * {normal_sql(1, 'seq', j)}" for j in range(10)]
    return _stream_sql(x, f"{[int(c) for c in classes]}[chosen]::INTEGER", rows)


def _drifting_sql() -> str:
    of, base = DRIFTING.base.seed * 1009 + 7, DRIFTING.base
    n = base.n_centroids
    weights = ", ".join(uniform_sql(of, "epoch", c, -1) + f" AS w{c}" for c in range(n))
    sums = [" + ".join(["0.0::DOUBLE", *[f"w{k}" for k in range(c + 1)]]) for c in range(n)]
    rows = f"""SELECT seq, epoch, least({" + ".join(f"({s} <= u * ({sums[-1]}))::INTEGER" for s in sums)}, {n - 1}) AS chosen FROM (
        SELECT seq, epoch, {uniform_sql(base.seed, "seq", -1)} AS u, {weights} FROM (SELECT seq, seq // {DRIFTING.drift_interval} AS epoch FROM (SELECT unnest(range(1, {ROWS + 1})) AS seq)))"""
    x = [f"{uniform_sql(of, 'epoch', 'chosen', j)} + 0.1::DOUBLE * {normal_sql(base.seed, 'seq', j)}" for j in range(base.n_features)]
    return _stream_sql(x, f"(floor({uniform_sql(of, 'epoch', 'chosen', -2)} * {base.n_classes}) + 1)::INTEGER", rows)


def _led_sql() -> str:
    rows = f"SELECT seq, floor({uniform_sql(1, 'seq', -1)} * 10)::INTEGER AS digit FROM (SELECT unnest(range(1, {ROWS + 1})) AS seq)"
    lit = lambda j: f"substr({_DIGITS}[digit + 1], {j + 1}, 1)::DOUBLE"
    x = [f"CASE WHEN {uniform_sql(1, 'seq', j)} < 0.1::DOUBLE THEN 1 - {lit(j)} ELSE {lit(j)} END" for j in range(7)]
    x += [f"({uniform_sql(1, 'seq', 7 + j)} < 0.5::DOUBLE)::INTEGER" for j in range(17)]
    return _stream_sql(x, "digit", rows)


def _agrawal_sql() -> str:
    u = lambda k: uniform_sql(1, "seq", k)
    whole = lambda k, low, high: f"floor({u(k)} * {high - low + 1}) + {low}"
    names = "salary commission age elevel car zipcode hvalue hyears loan".split()
    rows = f"""SELECT seq, 20000.0::DOUBLE + 130000.0::DOUBLE * {u(0)} AS salary, CASE WHEN {u(1)} < 0.5::DOUBLE THEN 0.0::DOUBLE ELSE 10000.0::DOUBLE + 65000.0::DOUBLE * {u(2)} END AS commission, {whole(3, 20, 80)} AS age,
        {whole(4, 0, 4)} AS elevel, {whole(5, 1, 20)} AS car, {whole(6, 0, 8)} AS zipcode, 50000.0::DOUBLE + 450000.0::DOUBLE * {u(7)} + 100000.0::DOUBLE * zipcode AS hvalue, {whole(8, 1, 30)} AS hyears, {u(9)} * 500000.0::DOUBLE AS loan
        FROM (SELECT unnest(range(1, {ROWS + 1})) AS seq)"""
    x = [f"{c} * (1.0::DOUBLE + 0.05::DOUBLE * (2 * {u(20 + j)} - 1))" for j, c in enumerate(names)]
    return _stream_sql(x, f"(NOT ({_RULES[2]}))::INTEGER", rows)


def _sea_sql() -> str:
    draws = ", ".join(f"{uniform_sql(1, 'seq', j)} * 10 AS a{j}" for j in range(3))
    rows = f"SELECT *, (a0 + a1 > {SEA_THRESHOLDS[1]!r}::DOUBLE)::INTEGER AS label FROM (SELECT seq, {draws} FROM (SELECT unnest(range(1, {ROWS + 1})) AS seq))"
    return _stream_sql(["a0", "a1", "a2"], _either(uniform_sql(1, "seq", 3), 0.1), rows)


def _plane_sql(generator) -> str:
    """With drift, the first two weights take a step up or down after every row."""
    w = [repr(float(v)) + "::DOUBLE" for v in generator.weights()]
    step = lambda j: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, w{j} + CASE WHEN {uniform_sql(1, 'seq', -2 - j)} < 0.5::DOUBLE THEN -1 ELSE 1 END * {generator.mag_change!r}::DOUBLE))"
    walked = f"WITH RECURSIVE s AS (SELECT 1::BIGINT AS seq, {w[0]} AS w0, {w[1]} AS w1 UNION ALL SELECT seq + 1, {step(0)}, {step(1)} FROM s WHERE seq < {ROWS}) SELECT seq, w0, w1 FROM s"
    fixed = f"SELECT unnest(range(1, {ROWS + 1})) AS seq, {w[0]} AS w0, {w[1]} AS w1"
    draws = ", ".join(f"{uniform_sql(1, 'seq', j)} AS a{j}" for j in range(10))
    names = ["w0", "w1", *w[2:]]
    side = " + ".join(f"{v} * a{j}" for j, v in enumerate(names))
    rows = f"SELECT *, ({side} >= ({' + '.join(names)}) / 2)::INTEGER AS label FROM (SELECT *, {draws} FROM ({walked if generator.mag_change else fixed}))"
    return _stream_sql([f"a{j}" for j in range(10)], _either(uniform_sql(1, "seq", -1), 0.05), rows)


def python_source(spark, sf_dir):
    register(spark)
    return spark.read.format("ebbflow_generator").option("n", 5000).option("function_id", 3).load()


_CUSTOMER = """SELECT c_custkey, 75000.0 + c_acctbal * 5 AS salary, c_custkey % 61 + 20 AS age, c_custkey % 5 AS elevel, c_custkey % 20 + 1 AS car, 50000.0 + c_custkey % 450 * 1000.0 AS hvalue,
    c_custkey % 30 + 1 AS hyears, c_custkey % 500 * 1000.0 AS loan FROM customer"""
#: Where each of the ten predicates gives class 0.
_RULES = (
    "age < 40 AND salary < 50000",
    "age < 40 AND salary BETWEEN 50000 AND 100000",
    "age BETWEEN 40 AND 60 AND salary < 75000",
    "age BETWEEN 40 AND 60 AND salary BETWEEN 75000 AND 125000",
    "age > 60 AND salary < 100000",
    "salary < 50000 AND elevel IN (0, 1)",
    "salary >= 75000 AND elevel >= 3",
    "age BETWEEN 25 AND 45 AND (car <= 5 OR car >= 15)",
    "hvalue >= 200000 AND hyears >= 10",
    "loan < 150000 AND hvalue >= 300000",
)
_DIGITS = "[" + ", ".join(f"'{s}'" for s in LED_SEGMENTS) + "]"

QUERIES = {
    "sea_labels": sea_labels, "agrawal_labels": agrawal_labels, "led_patterns": led_patterns, "sine_stream": _generated(SINE), "rbf_stream": _generated(RBF),
    "concept_drift_stream": _generated(DRIFTING), "led_stream": _generated(LED), "agrawal_stream": _generated(AGRAWAL), "sea_stream": _generated(SEA),
    "hyperplane_stream": _generated(PLANE), "hyperplane_drift_stream": _generated(TURNING), "python_source": python_source,
}
ORACLES = {
    "sine_stream": _stream_sql(["seq"], f"sin(0.1::DOUBLE * seq) + 0.1::DOUBLE * {normal_sql(1, 'seq')}"),
    "rbf_stream": _rbf_sql(), "concept_drift_stream": _drifting_sql(), "led_stream": _led_sql(), "agrawal_stream": _agrawal_sql(), "sea_stream": _sea_sql(),
    "hyperplane_stream": _plane_sql(PLANE), "hyperplane_drift_stream": _plane_sql(TURNING),
    "sea_labels": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
    + ", ".join(f"(l_quantity / 5 + l_tax * 50 > {t!r}::DOUBLE)::INTEGER AS y{k}" for k, t in enumerate(SEA_THRESHOLDS, 1))
    + " FROM lineitem",
    "agrawal_labels": f"SELECT c_custkey, {', '.join(f'(NOT ({r}))::INTEGER AS y{k}' for k, r in enumerate(_RULES, 1))} FROM ({_CUSTOMER})",
    "led_patterns": f"SELECT p_partkey, (p_partkey % 10)::INTEGER AS digit, s::INTEGER AS segment, substr({_DIGITS}[(p_partkey % 10 + 1)::INTEGER], (s + 1)::INTEGER, 1)::DOUBLE AS lit FROM part, (SELECT unnest(range(7)) AS s)",
}
