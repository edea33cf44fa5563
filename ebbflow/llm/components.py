"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Edges stay on the executors. A step takes the minimum of each node, which
starts before the shuffle, and hands it to the node's neighbours by a join. Both
sides of that join are stored tables, so where one node has very many edges
Spark's skew handling splits it (it doesn't where a side is an aggregation).
Lineage stays short, and the number of rounds grows with the logarithm of the
number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import cut_lineage


def _least(ways: DataFrame) -> DataFrame:
    """``of, m``: for each node its least neighbour or itself. Stored, so that a join with it can be split."""
    return cut_lineage(ways.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "of")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(hi, lo)`` with ``hi > lo``; each node hands its least neighbour to the others."""
    ways = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        ways = ways.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = _least(ways)
    met = ways.join(least, F.col("u") == F.col("of"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = met.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("of").alias("hi"), F.col("m").alias("lo")))
    return out.where(F.col("hi") > F.col("lo")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` but the roots; ``root`` is the least node of its component.

    Null ends, loops and repeated edges are ignored. Nodes are longs in their
    signed order.
    """
    state = cut_lineage(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("hi") > F.col("lo")))
        .distinct()
    )
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = print_of(state)
    if not before[0]:
        return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(most_rounds):
        state = cut_lineage(_star(_star(state, True), False))
        now = print_of(state)
        if now == before:
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
