"""Streams give what batches give, however the input is split; generators; the Python source."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.operators.bayes import GaussianNB
from ebbflow.operators.drift import ADWIN, DDM
from ebbflow.operators.evaluate import holdout_score, interleaved_test_then_train, progressive_val_score
from ebbflow.operators.linear import LogisticRegression, Perceptron
from ebbflow.operators.metrics import Accuracy
from ebbflow.operators.neighbours import KNN
from ebbflow.operators.trees import HoeffdingTree
from ebbflow.sources import generators as G
from ebbflow.streaming.runner import run_available, running_totals, write_available
from ebbflow.streaming.source import register

SCHEMA = "seq long, k int, a double, b double, y int, e int"


@pytest.fixture(scope="module")
def table(spark):
    x, y = G.SEAGenerator(1, 0.1, 7).columns(F.col("id"))
    rows = spark.range(600).select(F.col("id").alias("seq"), (F.col("id") % 4).cast("int").alias("k"), x.alias("x"), y.alias("y"))
    return rows.select("seq", "k", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), "y", (F.col("seq") % 150 > 100).cast("int").alias("e"))


@pytest.mark.parametrize("op", [Perceptron(), HoeffdingTree(30, tau=0.5), GaussianNB(), KNN(3, 50), DDM(min_instances=10), ADWIN(0.1)])
def test_stream_equals_batch(spark, table, tmp_path, op):
    """Files arrive in order over several runs of one query; state survives between them."""
    features, target = (["a", "b"], "y") if op.supervised else ("e", None)
    folder = tmp_path / "in"
    for part, (low, high) in enumerate(((0, 200), (200, 201), (201, 600))):
        table.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        write_available(op.stream(stream, features, target, "seq", "k"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = op.prequential(table, features, target, "seq", "k")
    said = [c for c in ("y_pred", "status") if c in expected.columns]
    assert got.select("seq", *said).orderBy("seq").collect() == expected.select("seq", *said).orderBy("seq").collect()


def test_stream_of_many_keys(spark, tmp_path):
    """What the store and the calls cost is bounded, however many keys there are; null keys are one key, and null orders come first."""
    rows = spark.range(18_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 6000 > 4, F.col("id") % 6000).alias("k"), (F.col("id") % 7 == 0).cast("int").alias("e"))
    rows = rows.withColumn("at", F.when(F.col("seq") % 11 > 0, -F.col("seq")))
    op, folder = DDM(min_instances=2), tmp_path / "in"
    for low, high in ((0, 9000), (9000, 18_000)):
        rows.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("seq long, k long, e int, at long").parquet(str(folder))
        out = op.stream(stream, "e", None, ["at", "seq"], "k")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= 4096
    expected = op.prequential(rows.withColumn("part", (F.col("seq") >= 9000).cast("int")), "e", None, ["part", "at", "seq"], "k")
    got = spark.read.parquet(str(tmp_path / "out")).select("seq", "k", "at", "status")
    assert got.orderBy("seq").collect() == expected.select("seq", "k", "at", "status").orderBy("seq").collect()
    assert got.where("status > 0").count() > 0


def test_keyless_stream(spark, table, tmp_path):
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = run_available(LogisticRegression().stream(stream, ["a", "b"], "y", "seq", None), str(tmp_path / "checkpoint"))
    expected = LogisticRegression().prequential(table, ["a", "b"], "y", "seq")
    assert got.select("seq", "y_pred").orderBy("seq").collect() == expected.select("seq", "y_pred").orderBy("seq").collect()


def test_mergeable_stream(spark, table, tmp_path):
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = running_totals(stream.withColumnsRenamed({"e": "pred", "y": "label"}), [Accuracy().aggregate().alias("value")], ["k"])
    got = run_available(totals, str(tmp_path / "checkpoint"), "complete")
    expected = Accuracy().score(table, "e", "y", "k")
    assert sorted((r["k"], round(r["value"], 9)) for r in got.collect()) == sorted((r["k"], round(r["value"], 9)) for r in expected.collect())


def test_python_source(spark, tmp_path):
    register(spark)
    batch = spark.read.format("ebbflow_generator").option("n", 900).option("partitions", 3).load()
    assert batch.count() == 900 and batch.where("x[0] < 0 or x[0] >= 10").count() == 0
    assert batch.where((F.col("x")[0] + F.col("x")[1] > 8) == (F.col("y") == 1)).count() > 750
    again = spark.read.format("ebbflow_generator").option("n", 900).option("partitions", 7).load()
    assert batch.orderBy("seq").collect() == again.orderBy("seq").collect()
    stream = spark.readStream.format("ebbflow_generator").option("n", 900).option("rowsPerBatch", 400).load()
    query = stream.writeStream.format("memory").queryName("generated").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("generated").orderBy("seq").collect() == batch.orderBy("seq").collect()


@pytest.mark.parametrize(
    ("generator", "d"),
    [(G.SineGenerator(), 1), (G.RandomRBFGenerator(3, 4, 10), 4), (G.LEDGenerator(), 24), (G.LEDGenerator(irrelevant_features=False), 7), (G.AgrawalGenerator(5), 9), (G.SEAGenerator(3), 3), (G.HyperplaneGenerator(6), 6), (G.HyperplaneGenerator(6, mag_change=0.05), 6)],
)
def test_generators(spark, generator, d):
    rows = generator.frame(spark, 400)
    out = rows.orderBy("seq").collect()
    assert len(out) == 400 and all(len(r["x"]) == d for r in out) and [r["seq"] for r in out] == list(range(1, 401))
    assert generator.frame(spark, 400).repartition(7).orderBy("seq").collect() == out
    assert generator.frame(spark, 100, 301).orderBy("seq").collect() == out[300:]
    if not isinstance(generator, G.SineGenerator):
        assert len({r["y"] for r in out}) > 1


def test_generator_rules(spark):
    x, y = zip(*[(r["x"], r["y"]) for r in G.SEAGenerator(2, noise=0.0).frame(spark, 300).collect()], strict=True)
    assert [int(a + b > 9.0) for a, b, _ in x] == list(y)
    lit = G.LEDGenerator(noise=0.0, irrelevant_features=False).frame(spark, 100).collect()
    assert all("".join(str(int(v)) for v in r["x"]) == G.LED_SEGMENTS[r["y"]] for r in lit)
    people = G.AgrawalGenerator(1, perturbation=0.0).frame(spark, 300).collect()
    assert all((r["y"] == 0) == (r["x"][2] < 40 and r["x"][0] < 50_000) for r in people)
    sine = [r["y"] for r in G.SineGenerator(noise=0.0).frame(spark, 50).orderBy("seq").collect()]
    assert sine == pytest.approx(np.sin(0.1 * np.arange(1, 51)))
    classes = {r["y"] for r in G.RandomRBFGenerator(2).frame(spark, 200).collect()}
    assert classes == {1, 2}
    for bad in (lambda: G.AgrawalGenerator(11), lambda: G.SEAGenerator(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        G.ConceptDriftStream(G.SEAGenerator(), drift_type="gradual")


def test_concept_drift_changes_centroids(spark):
    stream = G.ConceptDriftStream(G.RandomRBFGenerator(2, 2, 3), 200)
    rows = stream.frame(spark, 399).withColumn("epoch", F.floor(F.col("seq") / 200))
    means = rows.groupBy("epoch").agg(F.avg(F.get("x", F.lit(0))).alias("m")).orderBy("epoch").collect()
    assert len(means) == 2 and abs(means[0]["m"] - means[1]["m"]) > 1e-3


def test_evaluation(spark):
    rows = G.SEAGenerator(1, 0.05, 3).wide(spark, 800, 3)
    scored = progressive_val_score(LogisticRegression(), rows, Accuracy(), ["x0", "x1", "x2"], "y", "seq", n_samples=500)
    assert scored.score.first()["score"] > 0.5 and scored.trajectory.count() == 499
    said = {r["seq"]: r["y_pred"] == r["y"] for r in scored.rows.collect()}
    last = scored.trajectory.orderBy(F.col("seq").desc()).first()
    assert last["value"] == pytest.approx(sum(said.values()) / len(said)) == scored.score.first()["score"]
    one = progressive_val_score(LogisticRegression(), rows, Accuracy(), ["x0", "x1", "x2"], "y", "seq", n_samples=1)
    assert np.isnan(one.score.first()["score"]) and one.trajectory.count() == 0
    assert holdout_score(GaussianNB(), rows, Accuracy(), ["x0", "x1", "x2"], "y", "seq", train_size=500, test_size=300).first()["score"] > 0.8
    periodic = interleaved_test_then_train(GaussianNB(), rows, Accuracy(), ["x0", "x1", "x2"], "y", "seq", n_samples=400, period=100)
    assert [r["seq"] for r in periodic.trajectory.orderBy("seq").collect()] == [100, 200, 300, 400]
