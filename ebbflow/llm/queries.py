"""The registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import ann, byte_bpe, chat, packing, quality_classifier, quality_rules, simhash, substring, token_counts, token_output
from ebbflow.llm.shared import scratch, stored


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file; the package lies at the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_output.write_token_files(
        table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2, drops_space=True
    )
    return token_output.token_digests(spark, path)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip_digests(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(table(spark, sf_dir, "documents"), window=35)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_counts.suffix_sums(histogram).withColumnRenamed("group", "lang")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    template = chat.Template()
    return chat.formatted_digests(stored(chat.format_conversations(rows, template)), template)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, max_length=2048, digest=True)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("bucket").alias("bucket")
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_simhash": op2_simhash,
        "op3_token_output": op3_token_output,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_substring": op5_substring,
        "op6_token_counts": op6_token_counts,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_chat_format": op8_chat_format,
        "op9_packing": op9_packing,
        "op10_nearest_neighbours": op10_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.rules_sql(),
        "op5_substring": substring.digests_sql("documents", window=35),
        "op8_chat_format": chat.digests_sql(
            """SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'""",
            chat.Template(),
        ),
    }
