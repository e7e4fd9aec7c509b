"""Connected components of a link table in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverloom.llm import common


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that a link names; the component is its smallest id.

    Links are undirected; repeated links and links of an id to itself change nothing. Each step moves neighbours of
    an id to its smallest neighbour: first the larger ones, then the smaller ones, until all links are stars. The number
    of steps grows with the logarithm of the longest chain. Every step's links are written to the shared folder, so the plan stays short and a
    lost executor costs one step; the smallest neighbour is found by partial aggregation and written, so the join that
    hands it back to a hub's many links is one that adaptive execution can split.
    """
    with common.Scratch(links.sparkSession) as scratch:
        plain = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
        now = common.written(plain, "links")
        while True:
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            large = common.written(large, "links")
            smallest = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = (
                large.join(smallest, "u")
                .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
                .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
                .where("u <> v")
                .distinct()
            )
            now = common.written(small, "links")
            ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            ends = ends.unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
            ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
            if ends.where("out > 1 or (out = 1 and into = 1)").isEmpty():  # an id is in the middle or hangs on one
                break
        roots = now.select("v").distinct()
        found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
            roots.select(F.col("v").alias("id"), F.col("v").alias("component"))
        )
        return scratch.keep(found, "components")
