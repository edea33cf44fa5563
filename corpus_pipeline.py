"""Document pipeline: quality classifier, quality rules, near-duplicates, shared passages, packing.

Every stage but the last returns the columns of ``documents``. Where a run
keeps its stages' results, they are Parquet in the shared folder, so a lost
executor costs one stage's tasks and not the run.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ebbflow.llm import packing, quality_classifier, quality_rules, simhash, substring
from ebbflow.llm.shared import scratch

#: A document goes if the model holds it for bad rather than good.
LEAST_SCORE = 0.5
#: Words whose ids a worker of the last stage remembers; by then the executors' JVMs have grown.
CACHE = 150_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that aren't held out; drops those that score below ``LEAST_SCORE``."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model, LEAST_SCORE)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules."""
    return quality_rules.keep_good(docs)


def thin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates."""
    return simhash.keep_one(docs, radius=2, size=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words and more that occur elsewhere out of the texts."""
    return substring.remove_repeats(docs, window=35)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one piece of one document each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, max_length=2048, cache=CACHE)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", judge),
    ("simhash", thin),
    ("substring", cut_repeats),
    ("packing", pack),
]
#: Boosted trees, fingerprints and tokenizers have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and reread by the next."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
    return rows
