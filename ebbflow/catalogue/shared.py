"""Tables and columns that several queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an error flag, two features and a two-class label."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") == "error").cast("int").alias("err"),
        (F.col("value") / 100).alias("x1"), (F.col("event_id") % 7 / 7).alias("x2"), F.col("event_type").isin("purchase", "signup").cast("int").alias("y"),
    )


#: The same in SQL, with each row's place among its user's rows.
EVENTS = """SELECT event_id, ts, user_id, event_type, value, (event_type = 'error')::INTEGER AS err, value / 100 AS x1, (event_id % 7)::DOUBLE / 7 AS x2,
    (event_type IN ('purchase', 'signup'))::INTEGER AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"""


def dimensions(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, list[str]]:
    """Embeddings, whose vectors have ``n`` numbers, with these as columns ``e0, e1, ...``."""
    names = [f"e{i}" for i in range(n)]
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]), names


def dimensions_sql(n: int) -> str:
    return "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(n)) + " FROM embeddings"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with scaled features, a coded return flag and the columns that tell rows apart."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate", (F.col("l_extendedprice") / 1000).alias("price"),
        (F.col("l_quantity") / 10).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), flag.alias("flag"),
    )


LINEITEM = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_shipdate, l_extendedprice / 1000 AS price, l_quantity / 10 AS quantity,
    l_discount AS discount, l_tax AS tax, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem"""


def rounded(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


#: Added before rounding where values are often exact halves of the last place, which two engines may round apart.
NUDGE = 3.1e-8
