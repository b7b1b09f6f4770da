"""Connected components by alternating large-star and small-star rounds, on Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._text import narrow


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u long, v long) -> (node long, component long): each node with the smallest node it reaches.

    Self-loops and repeated edges are harmless; an empty table gives an empty one.  Minima are
    pre-aggregated before the shuffle and joined back, so a node with very many neighbours is
    split by adaptive skew handling and never gathered in one task.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = narrow(e), None
    for _ in range(rounds):
        tasks = e.rdd.getNumPartitions()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pair).alias("p")).select("p.*").where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        e = narrow(small)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
