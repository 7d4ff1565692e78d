"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of all nodes of ``edges`` (a, b): comp is the least node of the component.

    Alternates large-star and small-star steps until the edges are stars: each
    step is an aggregation and a join, a few rounds whatever the shape. A node
    of very many edges is combined before the shuffle in the aggregation and
    split by AQE in the join."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
