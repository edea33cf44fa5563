"""Prefix aggregates and windows in blocks against plain windows, also for a hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbflow.operators.metrics import MAE, Accuracy
from ebbflow.operators.transform import MinMaxScaler, StandardScaler, TargetEncoder
from ebbflow.plans.layout import Layout, assert_total_order
from ebbflow.plans.windows import halo_blocks, prefix, row_numbers, sliding


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows have one key; another key is null."""
    key = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, None).otherwise((F.col("id") % 11).cast("string"))
    value = F.when(F.col("id") % 17 == 0, None).otherwise((F.col("id") * 7919 % 1000) / 10)
    return spark.range(3000).select((F.col("id") * 37 % 3000).alias("seq"), key.alias("k"), value.alias("v")).cache()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("key", [None, "k"])
def test_prefix(rows, key, inclusive):
    frame = Window.partitionBy(*([key] if key else [])).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    expected = rows.select("seq", F.round(F.sum("v").over(frame), 6).alias("s"), F.count("v").over(frame).alias("c"), F.min("v").over(frame).alias("lo"), F.max("v").over(frame).alias("hi")).orderBy("seq").collect()
    v = F.col("v")
    got = prefix(rows, {"s": ("sum", v), "c": ("count", v), "lo": ("min", v), "hi": ("max", v)}, "seq", key, inclusive)
    assert got.select("seq", F.round("s", 6).alias("s"), "c", "lo", "hi").orderBy("seq").collect() == expected


def test_prefix_spreads_a_hot_key(rows):
    """No task holds more than a few blocks of the hot key."""
    out = row_numbers(rows, "seq", "k", "rn")
    assert out.where("k = 'hot'").agg(F.max("rn")).first()[0] == rows.where("k = 'hot'").count()
    from ebbflow.plans.windows import order_blocks

    blocks = rows.withColumn("b", order_blocks(rows, "seq").number()).groupBy("b").count().collect()
    assert len(blocks) > 20 and max(r["count"] for r in blocks) < 300


def test_row_numbers_by_other_types(spark):
    frame = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "s string, n int")
    assert [r["rn"] for r in row_numbers(frame, "s", None, "rn").orderBy("s").collect()] == [1, 2, 3]
    assert [r["rn"] for r in row_numbers(frame, ["n", "s"], None, "rn").orderBy(F.col("n").asc_nulls_first()).collect()] == [1, 2, 3]
    times = spark.createDataFrame([(i,) for i in range(50)], "i int").select("i", F.timestamp_seconds(F.col("i") * 1000).alias("t"))
    assert row_numbers(times, "t", None, "rn").where("rn = i + 1").count() == 50
    assert row_numbers(times.limit(0), "t", None, "rn").count() == 0


@pytest.mark.parametrize("width", [1, 2, 50, 700])
def test_sliding(rows, width):
    frame = Window.partitionBy("k").orderBy("seq").rowsBetween(-(width - 1), 0)
    expected = rows.select("seq", F.round(F.sum("v").over(frame), 6).alias("s")).orderBy("seq").collect()
    got = sliding(rows, {"s": F.sum("v")}, width, "seq", "k", rows_per_block=100).select("seq", F.round("s", 6).alias("s")).orderBy("seq").collect()
    assert got == expected


def test_halo_parts_are_bounded(rows):
    dealt = halo_blocks(rows, "seq", 20, "k", rows_per_block=100)
    assert dealt.groupBy("k", "__part").count().agg(F.max("count")).first()[0] <= 119
    assert dealt.where("not __halo").count() == rows.count()


def test_metrics_over_windows(rows):
    known = rows.where("v is not null").withColumns({"pred": (F.col("v") > 50).cast("int"), "label": (F.col("seq") % 2).cast("int")})
    frame = Window.partitionBy("k").orderBy("seq")
    for metric in (Accuracy(), MAE()):
        run = metric.running(known, "seq", "k").select("seq", F.round("value", 9).alias("v")).orderBy("seq").collect()
        assert run == known.select("seq", F.round(metric.over(frame.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("v")).orderBy("seq").collect()
        rolled = metric.rolling(known, 10, "seq", "k").select("seq", F.round("value", 9).alias("v")).orderBy("seq").collect()
        assert rolled == known.select("seq", F.round(metric.over(frame.rowsBetween(-9, 0)), 9).alias("v")).orderBy("seq").collect()


def test_running_transforms_end_where_batch_ones_are(rows):
    last = rows.where("k = 'hot'").agg(F.max("seq")).first()[0]
    for op in (StandardScaler(), MinMaxScaler()):
        a = op.prefix(rows, "v", "seq", "k").where(f"seq = {last} and k = 'hot'").first()["v"]
        b = op.fit(rows, "v", "k").transform(rows).where(f"seq = {last} and k = 'hot'").first()["v"]
        assert a == pytest.approx(b)
    encoder = TargetEncoder(2.0)
    halves = [encoder.fit(rows.where(f"seq % 2 = {r}"), "k", "v") for r in (0, 1)]
    whole = encoder.fit(rows, "k", "v").transform(rows).where("k = 'hot'").first()["encoded"]
    assert halves[0].merge(halves[1]).transform(rows).where("k = 'hot'").first()["encoded"] == pytest.approx(whole)
    strange = rows.limit(1).withColumn("k", F.lit("never seen"))
    assert encoder.fit(rows, "k", "v").transform(strange).first()["encoded"] == pytest.approx(rows.agg(F.avg("v")).first()[0])


def test_layout(rows):
    with pytest.raises(ValueError, match="order_by"):
        Layout.of(rows, "v", None, None)
    with pytest.raises(ValueError, match="no target"):
        Layout.of(rows, "v", "missing", "seq")
    with pytest.raises(ValueError, match="no feature"):
        Layout.of(rows.select("seq", "k"), None, "k", "seq")
    assert Layout.of(rows, None, None, "seq", "k").features == ("v",)
    assert_total_order(rows, "seq")
    with pytest.raises(ValueError, match="total order"):
        assert_total_order(rows, "k")


def test_one_exchange_feeds_window_and_fold(rows):
    """A prequential fold by key shuffles once."""
    from ebbflow.operators.linear import Perceptron

    frame = rows.where("v is not null").withColumn("y", F.col("seq") % 2)
    plan = Perceptron().prequential(frame, "v", "y", "seq", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scans_read_needed_columns_only(spark):
    from ebbflow import catalogue

    plan = catalogue.queries()["class_prior"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_expressions(spark):
    from ebbflow.functions import expressions as E

    out = spark.range(1).select(
        E.ks_statistic(F.expr("array(1.0D,2.0D,3.0D,4.0D,5.0D)"), F.expr("array(1.0D,2.0D,3.0D,4.0D,5.0D)")).alias("same"),
        E.ks_statistic(F.expr("array(1.0D,2.0D,3.0D,4.0D,5.0D)"), F.expr("array(10.0D,11.0D,12.0D,13.0D,14.0D)")).alias("apart"),
        E.ks_statistic(F.expr("array(1.0D,1.0D,2.0D)"), F.expr("array(1.0D,2.0D,2.0D)")).alias("ties"), E.entropy(F.expr("array(1, 1)")).alias("bit"), E.entropy(F.expr("array(0, 0)")).alias("none"),
        E.gini(F.expr("array(1, 1)")).alias("half"), E.argmax_label(F.expr("map(2, 0.5D, 1, 0.5D, 3, 0.1D)")).alias("tie"), E.sigmoid(F.lit(0.0)).alias("mid"),
        E.hoeffding_bound(1.0, 1e-7, F.lit(200)).alias("bound"),
    ).first()
    assert (out["same"], out["apart"], out["bit"], out["none"], out["half"], out["tie"], out["mid"]) == (0.0, 1.0, 1.0, 0.0, 0.5, 1, 0.5)
    assert out["ties"] == pytest.approx(1 / 3) and out["bound"] == pytest.approx(0.2007, abs=1e-3)
