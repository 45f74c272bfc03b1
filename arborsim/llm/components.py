"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborsim.llm import common


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges(u, v), root being the smallest node reachable; edges aren't collected.

    Each round is written to the shared folder and read again; the rounds are about the log of the longest path.
    They end when the edges are stars: no node points at two others, and none that is pointed at points on. More
    than ``most_rounds`` raise an error. The least neighbours are tables too, so that what meets them is a plain
    join of two exchanges, in which adaptive execution splits a hub's rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = common.materialise(e, "components")
    ends = lambda: e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    rounds = 0
    while not ends().groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
        if rounds == most_rounds:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "components")
        least = common.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e, old = common.materialise(small, "components"), (e, least, large)
        common.drop(*old)
        rounds += 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
