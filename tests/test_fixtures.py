"""Small exact cases: inputs and what must come out."""

from __future__ import annotations

import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.operators import metrics as M
from ebbflow.operators.adapters import knn_classifier, learnapi, naive_bayes_classifier, perceptron_classifier
from ebbflow.operators.anomaly import CutForest, GaussianProjectionDetector, HalfSpaceTrees, RandomCutForestApproximation
from ebbflow.operators.bayes import BernoulliNB, GaussianNB, MultinomialNB
from ebbflow.operators.cluster import StreamingKMeans, nearest
from ebbflow.operators.compose import ColumnTransformer, DriftRetrainingWrapper, FeatureUnion, OnlinePipeline
from ebbflow.operators.drift import ADWIN, DDM, EDDM, KSWIN, PageHinkley
from ebbflow.operators.ensemble import AdaptiveRandomForest, Bagging, DriftAwareBagging
from ebbflow.operators.linear import LogisticRegression, PassiveAggressive, Perceptron, Regression
from ebbflow.operators.neighbours import KNN
from ebbflow.operators.transform import MaxAbsScaler, MinMaxScaler, ModeImputer, OneHotEncoder, OrdinalEncoder, StandardScaler
from ebbflow.operators.trees import ExtremelyFastTree, HoeffdingAdaptiveTree, HoeffdingTree
from ebbflow.sources.streams import batch_stream, batches, from_columns, from_table, skip_stream, take_stream
from ebbflow.state import dict_argmax, load, merge, save


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pred double, label double")


def value(spark, metric, rows):
    return metric.score(pairs(spark, rows)).first()["value"]


def statuses(op, values):
    return op.run(op.initial(), np.array(values, dtype=float)[:, None], np.zeros(len(values)), True)["status"].tolist()


@pytest.mark.parametrize(
    ("metric", "rows", "expected"),
    [
        (M.Accuracy(), [(1, 1)] * 10 + [(0, 1)] * 10, 0.5), (M.Accuracy(), [], 0.0), (M.Precision(), [(1, 1)] * 8 + [(1, 0)] * 2 + [(0, 0)] * 5, 0.8),
        (M.Recall(), [(1, 1)] * 6 + [(0, 1)] * 4, 0.6), (M.F1Score(), [(1, 1)] * 80 + [(0, 1)] * 20 + [(1, 0)] * 20, 0.8), (M.MAE(), [(0, 1), (0, 2), (0, 3)], 2.0),
        (M.MSE(), [(0, 1), (0, 2), (0, 3)], 14 / 3), (M.RMSE(), [(0, 1), (0, 2), (0, 3)], math.sqrt(14 / 3)), (M.R2(), [(1, 1), (2, 2), (3, 3)], 1.0),
        (M.R2(), [(5, 2), (5, 2)], 1.0), (M.Precision(0), [(0, 0), (0, 1)], 0.5), (M.Accuracy(), [(None, 1), (1, None), (1, 1)], 1.0), (M.MAE(), [], 0.0),
    ],
)
def test_metrics(spark, metric, rows, expected):
    assert value(spark, metric, [tuple(None if v is None else float(v) for v in r) for r in rows]) == pytest.approx(expected)


def test_r2_of_one_row_is_nan(spark):
    assert math.isnan(value(spark, M.R2(), [(1.0, 1.0)]))


def test_rolling_metric(spark):
    rows = spark.createDataFrame([(i, 1 if i <= 5 else 0, 1) for i in range(1, 11)], "seq int, pred int, label int")
    out = [r["value"] for r in M.RollingMetric(M.Accuracy(), 5).running(rows, "seq").orderBy("seq").collect()]
    assert out[4] == 1.0 and out[9] == 0.0 and out[7] == pytest.approx(0.4)
    kept = M.RollingMetric(M.Precision(0), 3).running(rows, "seq").orderBy("seq").collect()
    assert kept[9]["value"] == 0.0


def test_regression(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(6)], "x double, y double")
    a, b = Regression().fit(rows.where("x < 3"), "x", "y"), Regression().fit(rows.where("x >= 3"), "x", "y")
    whole, merged = Regression().fit(rows, "x", "y").coefficients().first(), merge(a, b).coefficients().first()
    assert merged["n"] == 6 and merged["coef"] == pytest.approx(whole["coef"]) and whole["coef"] == pytest.approx([1.0, 2.0])
    assert a.update(rows.where("x >= 3")).coefficients().first()["coef"] == pytest.approx([1.0, 2.0])
    empty = Regression().fit(rows.limit(0), "x", "y")
    assert {r["y_pred"] for r in empty.predict(rows).collect()} == {0.0}
    single = Regression().fit(rows.where("x = 1"), "x", "y")
    assert single.coefficients().first()["coef"] is None
    assert Regression().fit(rows, "x", "y").intercept().first()["intercept"] == pytest.approx(1.0)


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((100, 3))
    y = 3 + 2 * x[:, 0] - 1.5 * x[:, 1] + 0.5 * x[:, 2] + 0.1 * rng.standard_normal(100)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    assert Regression().fit(rows, ["a", "b", "c"], "y").coefficients().first()["coef"] == pytest.approx([3, 2, -1.5, 0.5], abs=0.1)


def xy(spark, rows, d=1):
    return spark.createDataFrame([(i, *map(float, x), y) for i, (x, y) in enumerate(rows)], "seq long, " + ", ".join(f"x{k} double" for k in range(d)) + ", y int")


@pytest.mark.parametrize("op", [GaussianNB(), BernoulliNB(), MultinomialNB()])
def test_naive_bayes_probabilities(spark, op):
    rows = xy(spark, [([0], 0), ([1], 1), ([2], 2)])
    model = op.fit(rows, "x0", "y")
    for r in model.predict(rows).collect():
        assert set(r["proba"]) == {0, 1, 2} and sum(r["proba"].values()) == pytest.approx(1)
    assert {r["label"]: r["prior"] for r in model.class_prior().collect()} == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3})
    empty = op.fit(rows.limit(0), "x0", "y").predict(rows).first()
    assert empty["y_pred"] == 0 and empty["proba"] == {}
    # the fold by rows ends where the aggregate does
    state = op.initial()
    x, y = np.array([[0.0], [1.0], [2.0]]), np.array([0.0, 1.0, 2.0])
    op.run(state, x, y, False)
    assert [int(v) for v in op.apply(state, x)["y_pred"]] == [r["y_pred"] for r in model.predict(rows).orderBy("seq").collect()]


@pytest.mark.parametrize("op", [Perceptron(), PassiveAggressive(), PassiveAggressive(mode="pa2"), LogisticRegression()])
def test_order_matters_for_sequential_learners(spark, op):
    rows = xy(spark, [([0], 1), ([1], 1), ([3], 0)])
    a = op.fit(rows, "x0", "y", "seq").state.first()
    b = op.fit(rows.withColumn("seq", -F.col("seq")), "x0", "y", "seq").state.first()
    assert (a["w"], a["b"]) != (b["w"], b["b"]) and a["n"] == b["n"] == 3
    with pytest.raises(TypeError):
        merge(op.fit(rows, "x0", "y", "seq"), op.fit(rows, "x0", "y", "seq"))


def test_untrained_binary_learners(spark):
    rows = xy(spark, [([1], 1)])
    model = Perceptron().fit(rows.limit(0), "x0", "y", "seq")
    assert model.state.count() == 0
    r = model.predict(rows).first()
    assert r["y_pred"] == 0 and r["proba"] == 0.5


def test_kmeans():
    op = StreamingKMeans(2, 0.5)
    state = op.initial()
    op.run(state, np.array([[0.0, 0], [10, 10]]), np.zeros(2), False)
    assert op.run(state, np.array([[2.0, 2], [8, 8]]), np.zeros(2), True)["cluster"].tolist() == [1, 2]
    assert op.dump(state) == {"n": 4, "centroids": [[1.0, 1.0], [9.0, 9.0]], "sizes": [2, 2]}
    backwards = op.initial()
    op.run(backwards, np.array([[8.0, 8], [2, 2], [10, 10], [0, 0]]), np.zeros(4), False)
    assert op.dump(backwards) != op.dump(state)
    for bad in (np.zeros((1, 1)), np.zeros((1, 3))):
        with pytest.raises(ValueError):
            op.run(state, bad, np.zeros(1), False)
        with pytest.raises(ValueError):
            op.apply(state, bad)


def test_nearest_centroid_expression(spark):
    out = spark.range(1).select(nearest(F.expr("array(array(0.0D, 0.0D), array(4.0D, 4.0D))"), F.expr("array(3.0D, 3.0D)")).alias("c"), nearest(F.expr("cast(array() as array<array<double>>)"), F.expr("array(1.0D)")).alias("e")).first()
    assert (out["c"], out["e"]) == (2, 0)


def test_knn(spark):
    rows = xy(spark, [([0], 0), ([1], 1), ([2], 2), ([3], 3)])
    model = KNN(2, 3, weighted=False).fit(rows, "x0", "y", "seq")
    state = model.state.first()
    assert state["n"] == 4 and [v["x"] for v in state["window"]] == [[1.0], [2.0], [3.0]]
    asked = spark.createDataFrame([(9, 2.5, 0)], "seq long, x0 double, y int")
    assert set(model.predict(asked).first()["proba"]) == {2, 3}
    assert KNN(2, 3).fit(rows, "x0", "y", "seq").predict(spark.createDataFrame([(9, 3.0, 0)], "seq long, x0 double, y int")).first()["y_pred"] == 3
    op = KNN(2, 3)
    held = op.initial()
    op.run(held, np.zeros((1, 2)), np.zeros(1), False)
    with pytest.raises(ValueError):
        op.run(held, np.zeros((1, 3)), np.zeros(1), False)


def test_scalers(spark):
    rows = spark.createDataFrame([(i, *map(float, range(3 * i + 1, 3 * i + 4))) for i in range(4)], "seq int, a double, b double, c double")
    state = StandardScaler().fit(rows, ["a", "b", "c"]).state.first()
    columns = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]], dtype=float)
    assert state["mean"] == pytest.approx(columns.mean(axis=0)) and np.array(state["m2"]) / 3 == pytest.approx(columns.var(axis=0, ddof=1))
    low = spark.createDataFrame([(0.0, 10.0), (5.0, 50.0), (10.0, 100.0)], "a double, b double")
    out = MinMaxScaler().fit(low, ["a", "b"]).transform(spark.createDataFrame([(5.0, 55.0)], "a double, b double")).first()
    assert tuple(out) == (0.5, 0.5)
    with pytest.raises(NotImplementedError):
        MinMaxScaler().fit(low, ["a", "b"]).inverse_transform(low)
    signs = spark.createDataFrame([(1, 2.0, -4.0, 1.0)], "seq int, a double, b double, c double")
    assert tuple(MaxAbsScaler().fit_transform(signs, ["a", "b", "c"], "seq").first())[1:] == (1.0, -1.0, 1.0)
    zero = spark.createDataFrame([(0.0,)], "a double")
    model = MaxAbsScaler().fit(zero, "a")
    assert model.inverse_transform(model.transform(zero)).first()["a"] == 0.0
    halves = [StandardScaler().fit(rows.where(f"seq % 2 = {k}"), ["a", "b", "c"]) for k in (0, 1)]
    merged = halves[0].merge(halves[1]).state.first()
    assert merged["n"] == 4 and merged["mean"] == pytest.approx(state["mean"]) and merged["m2"] == pytest.approx(state["m2"])
    assert halves[0].update(rows.where("seq % 2 = 1")).state.first()["m2"] == pytest.approx(state["m2"])


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "seq int, c string")
    one = OneHotEncoder().fit(rows, "c", "seq")
    assert one.transform(rows.where("seq = 2"), "v").first()["v"] == [0.0, 1.0, 0.0]
    assert one.transform(spark.createDataFrame([("z",), (None,)], "c string"), "v").collect()[0]["v"] == [0.0, 0.0, 0.0]
    levels = spark.createDataFrame([(1, "low"), (2, "medium"), (3, "high")], "seq int, c string")
    code = OrdinalEncoder().fit(levels, "c", "seq")
    assert code.transform(levels, "v").where("c = 'medium'").first()["v"] == 2.0
    assert code.transform(spark.createDataFrame([("none",)], "c string"), "v").first()["v"] == 0.0
    assert [r["v"] for r in OrdinalEncoder().fit(rows, "c", "seq").transform(rows, "v", prefix=True).orderBy("seq").collect()] == [0.0, 0.0, 0.0, 1.0]


def test_mode_imputer(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None)], "seq int, v string")
    op = ModeImputer()
    assert op.transform(rows, "v", op.fit(rows, "v", "seq")).where("seq = 5").first()["imputed"] == "a"
    blank = spark.createDataFrame([(1, None)], "seq int, v string")
    assert op.prefix(blank, "v", "seq").first()["imputed"] is None


def test_adwin():
    op = ADWIN(0.01, 5)
    out = statuses(op, [0.0] * 40 + [1.0] * 40)
    assert set(out[:40]) == {0} and 2 in out[40:]
    state = op.initial()
    op.run(state, np.zeros((40, 1)), np.zeros(40), False)
    assert state["w"].width == 40
    op.run(state, np.ones((40, 1)), np.zeros(40), False)
    assert state["w"].width <= 40 and state["w"].values().mean() > 0.9 and state["n"] == 80
    with pytest.raises(ValueError):
        statuses(op, [float("inf")])


def test_ddm():
    assert statuses(DDM(min_instances=10), [0.0] * 40) == [0] * 40
    out = statuses(DDM(min_instances=20), [*([0.0] * 9 + [1.0]) * 5, *[1.0, 1.0, 1.0, 1.0, 0.0] * 20])
    assert 1 in out and 2 in out
    with pytest.raises(ValueError):
        statuses(DDM(), [0.5])
    with pytest.raises(ValueError):
        statuses(EDDM(), [-1.0])


def test_eddm():
    op, state = EDDM(min_instances=30), None
    at = np.cumsum([1, 2, 4, 4, 4, 5, 5, 7, 9])
    values = np.zeros(at[-1])
    values[at - 1] = 1
    state = op.initial()
    op.run(state, values[:, None], np.zeros(len(values)), False)
    assert state["n_errors"] == 9 and state["mean"] == pytest.approx(5.0) and state["std"] == pytest.approx(2.0)


def test_page_hinkley():
    out = statuses(PageHinkley(min_instances=10, threshold=5.0), [0.0] * 30 + [5.0] * 40)
    assert out.count(2) == 1 and 30 <= out.index(2) < 40


def test_kswin():
    op = KSWIN(0.01, 20, 10)
    state = op.initial()
    out = op.run(state, np.array([0.0] * 20 + [1.0] * 20)[:, None], np.zeros(40), True)["status"]
    assert 2 in out.tolist() and set(state["window"]) == {1.0} and state["n"] == 40


@pytest.mark.parametrize(
    "make",
    [
        lambda: ADWIN(0), lambda: ADWIN(1), lambda: ADWIN(0.1, 0), lambda: DDM(3, 2), lambda: EDDM(0.9, 0.95), lambda: PageHinkley(alpha=1.0), lambda: KSWIN(window_size=10, stat_size=6),
        lambda: KNN(0), lambda: StreamingKMeans(0), lambda: StreamingKMeans(1, 0), lambda: PassiveAggressive(mode="pa3"), lambda: HoeffdingTree(0), lambda: ExtremelyFastTree(delta=2),
        lambda: HoeffdingAdaptiveTree(split_criterion="x"), lambda: HalfSpaceTrees(0), lambda: GaussianProjectionDetector(0), lambda: RandomCutForestApproximation(0), lambda: Bagging(GaussianNB(), 0),
        lambda: Bagging(GaussianNB(), 3, float("inf")), lambda: OnlinePipeline(), lambda: M.RollingMetric(M.MAE(), 0),
    ],
)
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_streams(spark):
    x, y = [[float(i), 10.0 * i] for i in range(1, 6)], [0, 1, 0, 1, 1]
    rows = from_columns(spark, x, y).orderBy("seq").collect()
    assert len(rows) == 5 and (rows[0]["x"], rows[0]["y"]) == ([1.0, 10.0], 0) and rows[-1]["x"] == [5.0, 50.0]
    assert from_columns(spark, [], []).count() == 0
    frame = spark.createDataFrame([(i, float(i), 10.0 * i, i % 2) for i in range(1, 6)], "seq int, feature1 double, feature2 double, target int")
    assert from_table(frame, "target", order_by="seq").orderBy("seq").first()["x"] == [1.0, 10.0]
    with pytest.raises(ValueError):
        from_table(frame, "missing")
    hundred = spark.range(100).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    made = batches(hundred, 10, "id", ["a", "a"], "y").orderBy("batch_id").collect()
    assert len(made) == 10 and all(len(b["x"]) == 10 and len(b["x"][0]) == 2 for b in made) and made[0]["x"][3] == [3.0, 3.0]
    assert batch_stream(hundred, 30, "id").groupBy("batch_id").count().orderBy("batch_id").collect()[-1]["count"] == 10
    assert [r["id"] for r in take_stream(skip_stream(hundred, 10, "id"), 5, "id").orderBy("id").collect()] == [10, 11, 12, 13, 14]


def test_composition(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "a double, b double")
    assert len(FeatureUnion(StandardScaler(), MinMaxScaler()).fit(rows, ["a", "b"]).transform(rows).first()["features"]) == 4
    mixed = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 30.0), (3, 5.0, 50.0)], "seq int, a double, b double")
    op = ColumnTransformer([("one", StandardScaler(), "a"), ("two", MinMaxScaler(), "b")])
    assert op.fit(mixed, ["a", "b"]).transform(mixed).where("seq = 3").first()["features"] == pytest.approx([1.0, 1.0])
    assert op.fit_transform(mixed, ["a", "b"], "seq").where("seq = 1").first()["features"] == [0.0, 0.0]
    assert OnlinePipeline(StandardScaler(), Perceptron()).n_components == 2
    pipe = StandardScaler() >> MaxAbsScaler() >> Perceptron()
    assert isinstance(pipe, OnlinePipeline) and [type(c) for c in pipe.components] == [StandardScaler, MaxAbsScaler, Perceptron]
    union = StandardScaler() + MinMaxScaler() + MaxAbsScaler()
    assert len(union.fit(rows, ["a", "b"]).transform(rows).first()["features"]) == 6
    with pytest.raises(ValueError):
        OnlinePipeline(Perceptron(), StandardScaler())


def test_bagging_ignores_members_without_probabilities(spark):
    rows = xy(spark, [([0.5], 1)])
    out = Bagging(GaussianNB(), 3, rate=1.0, seed=1).fit(rows, "x0", "y", "seq").predict(rows).first()
    assert out["proba"] == {1: 1.0}
    assert AdaptiveRandomForest is DriftAwareBagging


def test_drift_aware_error_precedes_learning():
    from ebbflow.operators.ensemble import WatchedMember

    op = WatchedMember(GaussianNB(), DDM(min_instances=1))
    state = op.initial()
    op.run(state, np.array([[0.3, 1.0]]), np.array([1.0]), False)
    assert state["drift"]["errors"] == 1 and state["drift"]["n"] == 1


def test_anomaly_detectors_untrained(spark):
    rows = spark.createDataFrame([(1, 0.5)], "seq int, x double")
    assert HalfSpaceTrees().prequential(rows, "x", None, "seq").first()["score_one"] == 0.5
    assert GaussianProjectionDetector().fit(rows.limit(0), "x").score_one(rows).first()["score_one"] == 0.5
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.standard_normal((600, 2)))], "seq int, a double, b double")
    scores = [r["score_one"] for r in HalfSpaceTrees(window_size=50).prequential_parts(frame, ["a", "b"], "seq").collect()]
    assert len(scores) == 600 and all(0 <= s <= 1 for s in scores)


def test_cut_forest(spark):
    op = CutForest([0, 1, 2], 4, 7)
    state = op.initial()
    out = op.run(state, np.array([[float(i), 0.0] for i in range(1, 11)]), np.zeros(10), True)
    assert all(math.isfinite(v) for v in out["score"]) and out["size"][-1] == 4
    assert op.apply(state, np.array([[10.0, 0.0], [1.0, 0.0]]))["score"][1] is None
    again = op.load(op.dump(state))
    more = np.array([[3.5, 1.0], [8.0, 0.0]])
    assert op.run(again, more, np.zeros(2), True) == op.run(state, more, np.zeros(2), True)
    for t in state["trees"]:
        assert t.size[t.root] == 4 and len(t.leaf) == 4
    frame = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 11)], "seq int, a double, b double")
    forest = RandomCutForestApproximation(3, 4, 7, blocks=2)
    model = forest.fit(frame, ["a", "b"], "seq")
    scores = {r["seq"]: r["score"] for r in model.score(frame).collect()}
    assert scores[10] is not None and scores[1] is None
    assert tuple(model.inspect().first()) == (3, 4, 4)
    emitted = {r["seq"]: r["score"] for r in forest.fit_score(frame, ["a", "b"], "seq").collect()}
    assert emitted[10] == pytest.approx(scores[10]) and emitted[1] == 0.0


def test_cut_forest_equals_its_rules_with_few_calls_for_a_row():
    """Nested tuples as trees, one row at a time; before, each row took dozens of Python calls for each tree."""

    def mix(*parts):
        h = 0x9E3779B97F4A7C15
        for p in parts:
            h = (h ^ p) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 31
        return (h >> 11) / (1 << 53)

    def without(tree, number):
        if tree is None or isinstance(tree, int):
            return None if tree == number else tree
        a, b = without(tree[0], number), without(tree[1], number)
        return b if a is None else a if b is None else (a, b, *tree[2:])

    def added(tree, point, number, flat, dim, cut, first):
        """The tree with the point, and the point's depth."""
        if tree is None or isinstance(tree, int):
            return (number, 0) if tree is None else ((*((tree, number) if first else (number, tree)), dim, cut), 1)
        side = 0 if flat or point[tree[2]] <= tree[3] else 1
        below, depth = added(tree[side], point, number, flat, dim, cut, first)
        return ((below, *tree[1:]) if side == 0 else (tree[0], below, *tree[2:])), depth + 1

    x = np.concatenate((np.ones((3, 2)), np.random.default_rng(8).random((600, 2)).round(2)))
    op, expected = CutForest([2, 5], 9, 7), []
    trees: dict = {2: None, 5: None}
    for number, point in enumerate(x.tolist(), 1):
        low, high = x[:number].min(axis=0).tolist(), x[:number].max(axis=0).tolist()
        spans, score = [b - a for a, b in zip(low, high, strict=True)], 0
        for name, tree in trees.items():
            dim = 0 if mix(7, name, number, 0) * sum(spans) - spans[0] <= 0 else 1
            cut = low[dim] + mix(7, name, number, 1) * spans[dim] if sum(spans) > 0 else low[0]
            trees[name], depth = added(without(tree, number - 9), point, number, low == high, dim, cut, mix(7, name, number, 2) < 0.5)
            score += depth + min(number, 9) - 1
        expected.append(score)
    state, n = op.initial(), 0

    def count(frame, event, argument):
        nonlocal n
        n += event == "call"

    first = op.run(state, x[:100], None, True)["score"]
    sys.setprofile(count)
    try:
        rest = op.run(state, x[100:], None, True)["score"]
    finally:
        sys.setprofile(None)
    assert first + rest == expected
    assert n < len(x)


def test_drift_retraining_wrapper_resets():
    op = DriftRetrainingWrapper(Perceptron(), DDM(min_instances=5))
    state = op.initial()
    x = np.tile([[1.0, 0.0], [-1.0, 0.0]], (60, 1))
    y = np.concatenate((np.tile([1.0, 0.0], 40), np.tile([0.0, 0.0, 1.0, 1.0], 10)))
    out = op.run(state, x, y, True)
    assert state["drift_count"] == out["status"].count(2) >= 1 and state["n"] == 120
    first = DriftRetrainingWrapper(Perceptron(), DDM(min_instances=5), reset_first=True)
    held = first.initial()
    first.run(held, x, y, True)
    assert held["drift_count"] >= 1


def test_adapters(spark):
    rows = spark.createDataFrame([(i, float(i % 4), "yes" if i % 4 > 1 else "no") for i in range(40)], "seq int, x double, y string")
    model = naive_bayes_classifier(["no", "yes"]).fit(rows, "x", "y", "seq")
    assert {r["y_label"] for r in model.predict(rows).where("y = 'yes'").collect()} == {"yes"}
    more = model.update_observations(rows)
    assert more.fitted_params.first()["n"] == 80 and model.fitted_params.first()["n"] == 40
    with pytest.raises(ValueError):
        model.update_observations(spark.createDataFrame([(1, 1.0, "unknown")], "seq int, x double, y string"))
    with pytest.raises(ValueError):
        perceptron_classifier(["a", "b", "c"])
    assert perceptron_classifier(["no", "yes"]).fit(rows, "x", "y", "seq").predict(rows).select("y_pred").distinct().count() <= 2
    assert knn_classifier(["no", "yes"], k=3, window_size=20).fit(rows, "x", "y", "seq").predict(rows).first()["y_pred"] in (1, 2)
    numbers = rows.withColumn("t", F.col("x") * 2)
    config = learnapi(Regression())
    fitted = config.fit(numbers, "x", "t")
    assert fitted.predict(numbers).where("x = 3").first()["y_pred"] == pytest.approx(6.0)
    assert fitted.update_observations(numbers).fitted_params.first()["n"] == 80
    with pytest.raises(TypeError):
        learnapi(fitted)


def numbers_of(v):
    """All numbers of a nested state, in order."""
    if isinstance(v, tuple | list):
        return [n for item in v for n in numbers_of(item)]
    return [-1.0 if v is None else float(v)]


def test_state_tables(spark, tmp_path):
    rows = xy(spark, [([float(i % 5)], i % 2) for i in range(50)])
    first, rest = rows.where("seq < 20"), rows.where("seq >= 20")
    for op in (Perceptron(), LogisticRegression(), HoeffdingTree(10, tau=0.5), ExtremelyFastTree(10, tau=0.5), KNN(3, 10), StreamingKMeans(2), OnlinePipeline(StandardScaler(), Perceptron())):
        target = "y" if op.supervised else None
        whole = op.fit(rows, "x0", target, "seq").state.first()
        part = op.fit(first, "x0", target, "seq")
        path = str(tmp_path / type(op).__name__)
        save(part, path)
        resumed = load(part, spark, path).update(rest).state.first()
        assert numbers_of(resumed) == pytest.approx(numbers_of(whole), rel=1e-9), type(op).__name__
    assert dict_argmax({2: 1.0, 1: 1.0, 0: 0.5}) == 1 and dict_argmax({}) == 0
