"""Fast forms of sequential operators against their written steps, states across splits, native folds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.functions import optimizers as O
from ebbflow.operators.base import Stepped
from ebbflow.operators.bayes import GaussianNB
from ebbflow.operators.cluster import StreamingKMeans
from ebbflow.operators.compose import DriftRetrainingWrapper, OnlinePipeline
from ebbflow.operators.drift import ADWIN, DDM, EDDM, KSWIN, PageHinkley
from ebbflow.operators.ensemble import Bagging, DriftAwareBagging, Member, WatchedMember
from ebbflow.operators.linear import LogisticRegression, PassiveAggressive, Perceptron
from ebbflow.operators.neighbours import KNN
from ebbflow.operators.anomaly import HalfSpaceTrees
from ebbflow.operators.transform import MaxAbsScaler, MinMaxScaler, StandardScaler

rng = np.random.default_rng(11)
X = rng.standard_normal((700, 3))
Y = (X @ np.array([1.0, -2.0, 0.5]) + 0.3 * rng.standard_normal(700) > 0).astype(float)
BITS = np.concatenate(((rng.random(400) < 0.1), (rng.random(300) < 0.6), (rng.random(300) < 0.1))).astype(float)[:, None]
LEVELS = np.concatenate((rng.normal(0, 1, 300), rng.normal(4, 1, 300), rng.normal(-2, 3, 300)))[:, None]


def as_lists(found):
    return {k: [None if v is None else float(v) for v in values] for k, values in found.items()}


def same_state(a, b):
    for k in a:
        if isinstance(a[k], list):
            assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12), k
        elif isinstance(a[k], float) and math.isinf(a[k]):
            assert a[k] == b[k]
        else:
            assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12), k


@pytest.mark.parametrize(
    ("op", "x", "y"),
    [
        (Perceptron(), X, Y), (LogisticRegression(), X, Y), (LogisticRegression(O.Adam(0.05), 0.01, 0.02), X, Y), (DDM(min_instances=10), BITS, BITS[:, 0]), (EDDM(min_instances=5), BITS, BITS[:, 0]),
        (PageHinkley(10, threshold=20.0), LEVELS, LEVELS[:, 0]),
    ],
)
def test_fast_run_equals_steps(op, x, y):
    slow, fast = op.initial(), op.initial()
    expected = as_lists(Stepped.run(op, slow, x, y, True))
    got: dict = {}
    for a, b in ((0, 1), (1, 2), (2, 350), (350, len(x))):
        for k, v in as_lists(op.run(fast, x[a:b], y[a:b], True)).items():
            got.setdefault(k, []).extend(v)
    assert set(got) == set(expected)
    for k in got:
        assert got[k] == pytest.approx(expected[k], rel=1e-9) or k == "proba" and isinstance(op, Perceptron)
    same_state(fast, slow)
    if "drifts" in slow:
        assert slow["drifts"] > 0


def test_detectors_find_the_changes():
    for op in (DDM(), EDDM(min_instances=20), ADWIN(), PageHinkley(threshold=10.0), KSWIN()):
        values = BITS if isinstance(op, DDM | EDDM) else LEVELS
        out = op.run(op.initial(), values, np.zeros(len(values)), True)["status"]
        assert (np.asarray(out) == 2).sum() >= 1


def plain_adwin(values, delta, least):
    window, out = [], []
    for v in values:
        window.append(v)
        found = False
        while len(window) >= 2 * least:
            n, cut = len(window), 0
            mean = sum(window) / n
            var = sum((w - mean) ** 2 for w in window) / (n - 1)
            log_term = math.log(2 * math.log(max(n, 2)) / delta)
            for i in range(least, n - least + 1):
                h = 1 / i + 1 / (n - i)
                if abs(sum(window[:i]) / i - sum(window[i:]) / (n - i)) > math.sqrt(2 * h * var * log_term) + 2 / 3 * h * log_term:
                    cut = i
                    break
            if not cut:
                break
            window, found = window[cut:], True
        out.append(2 * found)
    return out, window


def test_adwin_equals_the_definition():
    values = LEVELS[250:420, 0].tolist()
    op = ADWIN(0.05, 5)
    state = op.initial()
    got = op.run(state, np.array(values)[:, None], np.zeros(len(values)), True)["status"].tolist()
    expected, window = plain_adwin(values, 0.05, 5)
    assert got == expected and 2 in got
    assert state["w"].values().tolist() == pytest.approx(window)


def test_adwin_pruned_scan_equals_full_scan():
    values = np.concatenate((rng.normal(0, 1, 1500), rng.normal(0.35, 1, 1500), rng.normal(0.2, 2, 500), rng.normal(3, 1, 200)))[:, None]
    pruned, full = ADWIN(0.05), ADWIN(0.05)
    full.STRETCH = 10**9
    a, b = pruned.initial(), full.initial()
    got, expected = pruned.run(a, values, np.zeros(len(values)), True)["status"], full.run(b, values, np.zeros(len(values)), True)["status"]
    assert got.tolist() == expected.tolist() and (got == 2).sum() >= 2
    assert a["w"].width == b["w"].width


@pytest.mark.parametrize("rule", [O.Descent(0.1), O.Momentum(), O.Nesterov(0.01), O.AdaGrad(), O.RMSProp(0.01), O.Adam(0.01), O.AdamW(0.01, decay=0.1), O.RAdam(0.01), O.NAdam(0.01), O.AdaMax(0.01), O.OAdam(0.01)])
def test_rules_lower_the_loss_and_run_natively(spark, rule):
    op = LogisticRegression(rule)
    state = op.initial()
    op.run(state, X, Y, False)
    assert np.mean((X @ np.array(state["w"]) + state["b"] >= 0) == (Y > 0)) > 0.85
    rows = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(X[:80], Y[:80], strict=True))], "seq int, a double, b double, c double, y int")
    native = op.fit_native(rows, ["a", "b", "c"], "y", "seq").state.first()
    python = op.fit(rows, ["a", "b", "c"], "y", "seq").state.first()
    assert native["w"] == pytest.approx(python["w"], rel=1e-9) and native["b"] == pytest.approx(python["b"], rel=1e-9) and native["n"] == 80


def test_adam_on_wide_rows_equals_steps():
    x = rng.standard_normal((80, 40))
    y = (x[:, 0] > 0).astype(float)
    op = LogisticRegression()
    slow, fast = op.initial(), op.initial()
    Stepped.run(op, slow, x, y, False)
    op.run(fast, x, y, False)
    same_state(fast, slow)


def test_adam_first_step_is_eta():
    """The first step of Adam is eta in the direction of the gradient, whatever its size."""
    op = LogisticRegression(O.Adam(0.01))
    state = op.initial()
    op.run(state, np.array([[3.0, -5.0]]), np.array([1.0]), False)
    assert state["w"] == pytest.approx([0.01, -0.01], rel=1e-5) and state["b"] == pytest.approx(0.01, rel=1e-5)


def test_native_fold_gives_large_keys_to_the_streaming_fold(spark):
    from ebbflow.plans.fold import native_fold

    rows = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(BITS[:100, 0])], "seq int, k int, e double")
    op = DDM(min_instances=5)
    at = op.layout(rows, "e", None, "seq", "k")
    a, b = (native_fold(rows, op, at, n).orderBy("k").select("k", "n", "errors", "drifts").collect() for n in (10, 1000))
    assert a == b


@pytest.mark.parametrize("scaler", [StandardScaler(), MinMaxScaler(), MaxAbsScaler()])
def test_pipeline_scales_by_rows_before_and_up_to(scaler):
    op = OnlinePipeline(scaler, Perceptron())
    state = op.initial()
    got = []
    for a, b in ((0, 3), (3, 200)):
        got += [int(v) for v in op.run(state, X[a:b], Y[a:b], True)["y_pred"]]
        state = op.load(op.dump(state))
    plain, held = Perceptron(), scaler.start(3)
    learner = plain.initial()
    expected = []
    for row, label in zip(X[:200], Y[:200], strict=True):
        before = scaler.current(held, row[None, :])
        expected.append(int(plain.apply(learner, before)["y_pred"][0]))
        scaler.steps(held, row[None, :])
        plain.one(learner, scaler.current(held, row[None, :])[0], label)
    assert got == expected
    assert np.mean(np.array(got[50:]) == Y[50:200]) > 0.7


def test_scaler_blocks_equal_single_rows():
    for op in (StandardScaler(), MinMaxScaler(), MaxAbsScaler()):
        state = op.start(3)
        before, after = op.both(state, X[:50])
        for i in (0, 1, 7, 49):
            held = op.start(3)
            if i:
                op.steps(held, X[:i])
            assert before[i] == pytest.approx(op.current(held, X[i : i + 1])[0])
            op.steps(held, X[i : i + 1])
            assert after[i] == pytest.approx(op.current(held, X[i : i + 1])[0])


def test_knn_equals_the_definition():
    op = KNN(3, 20)
    got = op.run(op.initial(), X[:120], Y[:120], True)
    for i in range(120):
        rows = range(max(0, i - 20), i)
        near = sorted(rows, key=lambda j: (np.linalg.norm(X[i] - X[j]), j))[:3]
        votes: dict = {}
        for j in near:
            votes[int(Y[j])] = votes.get(int(Y[j]), 0) + 1 / np.linalg.norm(X[i] - X[j])
        assert got["y_pred"][i] == (min(votes, key=lambda c: (-votes[c], c)) if votes else 0)


@pytest.mark.parametrize("distance", ["euclidean", "cityblock", "chebyshev", "minkowski", "cosine"])
def test_distances(spark, distance):
    from ebbflow.functions.expressions import distance as expression

    op = KNN(3, 20, distance=distance, p=3.0)
    expected = op._distances(X[:1], X[1:2])[0, 0]
    a, b = (F.array(*[F.lit(float(v)) for v in X[k]]) for k in (0, 1))
    assert spark.range(1).select(expression(distance, a, b, 3.0).alias("d")).first()["d"] == pytest.approx(expected)


def test_half_space_trees_equal_the_definition():
    op = HalfSpaceTrees(4, 3, 25, seed=2)
    dims, cuts = op.trees(3)
    latest, reference, scores = [dict() for _ in range(4)], [dict() for _ in range(4)], []

    def leaf(t, row):
        k = 0
        while k < len(cuts[t]):
            k = 2 * k + (1 if row[dims[t][k]] < cuts[t][k] else 2)
        return k

    for n, row in enumerate(X[:130]):
        scores.append(sum(reference[t].get(leaf(t, row), 0) * 8 for t in range(4)) / 4)
        if n and n % 25 == 0:
            reference, latest = latest, [dict() for _ in range(4)]
        for t in range(4):
            latest[t][leaf(t, row)] = latest[t].get(leaf(t, row), 0) + 1
    state, got = op.initial(), []
    for a, b in ((0, 25), (25, 26), (26, 130)):
        got += op.run(state, X[a:b], np.zeros(b - a), True)["score"].tolist()
    assert got == scores


def test_half_space_trees_in_parts_equal_the_fold(spark):
    rows = spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(X[:300])], "seq int, k int, a double, b double, c double")
    op = HalfSpaceTrees(5, 3, 30, seed=2)
    for key in (None, "k"):
        a = op.prequential(rows, ["a", "b", "c"], None, "seq", key).orderBy("seq").select("seq", "score", "score_one").collect()
        b = op.prequential_parts(rows, ["a", "b", "c"], "seq", key).orderBy("seq").select("seq", "score", "score_one").collect()
        assert a == b


def plain_bagging(op, rows, times, member):
    """Votes of members that are folded one by one."""
    states = [member.initial() for _ in range(op.n_estimators)]
    votes = []
    for i, (row, label) in enumerate(rows):
        said = [member.apply(s, np.append(row, 0.0)[None, :])["y_pred"][0] for s in states]
        votes.append(min(set(said), key=lambda c: (-said.count(c), c)))
        for m, s in enumerate(states):
            member.run(s, np.append(row, times[m][i])[None, :], np.array([label]), False)
    return votes


@pytest.mark.parametrize("kind", [Bagging, DriftAwareBagging])
def test_bagging_equals_members_one_by_one(spark, kind):
    op = kind(GaussianNB(), n_estimators=3, seed=4) if kind is Bagging else kind(GaussianNB(), DDM(min_instances=10), 3, seed=4)
    rows = [(X[i], Y[i]) for i in range(120)]
    frame = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(rows)], "seq int, a double, b double, c double, y int")
    counted = frame.select("seq", *[op.times(F.lit(m), ("seq",)).alias(f"t{m}") for m in range(3)]).orderBy("seq").collect()
    times = [[r[f"t{m}"] for r in counted] for m in range(3)]
    got = [r["y_pred"] for r in op.prequential(frame, ["a", "b", "c"], "y", "seq").orderBy("seq").collect()]
    assert got == plain_bagging(op, rows, times, op.member)
    assert isinstance(op.member, WatchedMember) == (kind is DriftAwareBagging) and isinstance(op.member, Member)
    again = [r["y_pred"] for r in op.prequential(frame.repartition(7), ["a", "b", "c"], "y", "seq").orderBy("seq").collect()]
    assert again == got
    model = op.fit(frame, ["a", "b", "c"], "y", "seq")
    assert model.state.count() == 3 and model.per_learner_drifts().count() == 3 and model.total_drifts().count() == 1
    said = {r["seq"]: (r["y_pred"], r["proba"]) for r in model.predict(frame).collect()}
    assert np.mean([said[i][0] == int(rows[i][1]) for i in said]) > 0.8
    keyed = op.fit(frame.withColumn("k", F.lit("one")), ["a", "b", "c"], "y", "seq", "k").predict(frame.withColumn("k", F.lit("one")))
    for r in keyed.collect():
        assert r["y_pred"] == said[r["seq"]][0] and r["proba"] == pytest.approx(said[r["seq"]][1])


def test_poisson_counts(spark):
    from ebbflow.functions.expressions import poisson

    for rate in (1.0, 6.0):
        row = spark.range(20_000).select(poisson(rate, 3, F.col("id")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert row[0] == pytest.approx(rate, rel=0.05) and row[1] == pytest.approx(rate, rel=0.08)


def test_order_and_partitions_make_no_difference(spark):
    rows = spark.createDataFrame([(i, i % 3, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(X, Y, strict=True))], "seq int, k int, a double, b double, c double, y int")
    for op in (PassiveAggressive(), StreamingKMeans(), DriftRetrainingWrapper(Perceptron(), ADWIN())):
        target = "y" if op.supervised else None
        runs = [op.prequential(frame, ["a", "b", "c"], target, "seq", "k").orderBy("seq").collect() for frame in (rows, rows.repartition(5), rows.orderBy(F.col("seq").desc()).coalesce(1))]
        assert runs[0] == runs[1] == runs[2]


def test_nulls_take_no_part(spark):
    rows = spark.createDataFrame([(1, 1.0, 1), (2, None, 0), (3, 2.0, None), (4, float("nan"), 1), (5, -1.0, 0)], "seq int, x double, y int")
    whole = rows.where("seq in (1, 5)")
    for op in (Perceptron(), LogisticRegression(), HalfSpaceTrees(2, 2, 2), GaussianNB()):
        target = "y" if op.supervised else None
        if op.supervised:
            assert op.fit(rows, "x", target, "seq").state.collect() == op.fit(whole, "x", target, "seq").state.collect()
        assert op.fit(rows.limit(0), "x", target, "seq").state.where("n > 0").count() == 0
    out = Perceptron().prequential(rows, "x", "y", "seq").orderBy("seq").collect()
    assert [r["y_pred"] is None for r in out] == [False, True, True, True, False]


def test_null_keys_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 1.0, 1, "a"), (2, None, -1.0, 0, "b"), (3, "k", 1.0, 1, "c")], "seq int, `my.key` string, __x double, y int, __row string")
    out = Perceptron().prequential(rows, "__x", "y", "seq", "my.key").orderBy("seq").collect()
    assert len(out) == 3 and out[0].asDict().keys() >= {"my.key", "__x", "__row", "y_pred"}
    state = Perceptron().fit(rows, "__x", "y", "seq", "my.key")
    assert {r["my.key"]: r["n"] for r in state.state.collect()} == {None: 2, "k": 1}
    assert state.predict(rows).count() == 3
