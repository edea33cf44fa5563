"""Headline queries on one machine. Prints one line of JSON.

``queries`` are seconds of whole queries over ``$BENCH_SF_DIR`` (rows written
to a sink that drops them). ``rows_per_sec`` are fits of 100,000 generated rows
of 10 features, generation included, as in the published figures.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "gaussian_nb_predict", "bernoulli_nb_predict", "multinomial_nb_predict", "linreg_coef_1d", "linreg_prefix_predict", "standard_scale_prefix", "target_encode_prefix",
    "mode_impute_prefix", "rolling_mae_100", "regression_metrics", "knn_prequential", "kswin_status", "ddm_status", "eddm_status", "page_hinkley_status", "adwin_status",
    "perceptron_fit", "logistic_adam_fit", "kmeans_fit", "pipeline_scaler_perceptron_prequential", "progressive_accuracy_trajectory", "drift_retraining_wrapper",
    "hoeffding_tree_predict", "efdt_predict", "half_space_trees_score", "rcf_scores", "bagging_predict",
)
ROWS, D = 100_000, 10


def drop(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def fits(spark) -> dict:
    """Name -> function that generates and learns ``ROWS`` rows."""
    from pyspark.sql import functions as F

    from ebbflow.operators.bayes import GaussianNB
    from ebbflow.operators.drift import ADWIN, DDM
    from ebbflow.operators.linear import LogisticRegression, Perceptron, Regression
    from ebbflow.operators.trees import HoeffdingTree
    from ebbflow.sources.generators import RandomRBFGenerator

    names = [f"x{i}" for i in range(D)]
    rows = lambda seed: RandomRBFGenerator(seed=seed).wide(spark, ROWS, D).withColumn("y", F.col("y") - 1)
    scalars = lambda: spark.range(ROWS).select("id", (F.rand(1) + F.when(F.col("id") >= ROWS // 2, 0.5).otherwise(0.0)).alias("v"))
    return {
        "logistic_regression": lambda: drop(LogisticRegression().fit(rows(42), names, "y", "seq").state),
        "perceptron": lambda: drop(Perceptron().fit(rows(43), names, "y", "seq").state),
        "linear_regression": lambda: drop(Regression().fit(rows(44), names, "y").coefficients()),
        "hoeffding_tree": lambda: drop(HoeffdingTree().fit(rows(45), names, "y", "seq").state),
        "gaussian_nb": lambda: drop(GaussianNB().fit(rows(46), names, "y").state),
        "adwin": lambda: drop(ADWIN().prequential(scalars(), "v", None, "id")),
        "ddm": lambda: drop(DDM().prequential(scalars().withColumn("v", (F.col("v") > 0.95).cast("int")), "v", None, "id")),
    }


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from ebbflow import catalogue

    every = catalogue.queries()
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    drop(every["ddm_status"](spark, sf_dir))  # starts workers
    seconds, rates = {}, {}
    for name in chosen:
        began = time.perf_counter()
        drop(every[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - began, 3)
    for name, run in fits(spark).items():
        run()
        began = time.perf_counter()
        run()
        rates[name] = round(ROWS / (time.perf_counter() - began))
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
