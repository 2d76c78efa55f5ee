"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import settle


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node long, component long (the smallest node reachable), one row for each node that has an edge to another.

    Alternating large-star and small-star steps: each halves the depth of the trees or so, so the rounds grow
    with the logarithm of the longest path.  No step gathers a component in one place; minima are pre-aggregated.
    Null nodes, loops and repeated edges are ignored.
    """
    now = settle(
        edges.select(F.greatest(F.col(left), F.col(right)).cast("long").alias("hi"), F.least(F.col(left), F.col(right)).cast("long").alias("lo"))
        .where("hi is not null and lo is not null and hi <> lo").distinct()
    )
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e")).select("e.hi", F.col("e.m").alias("lo"))
        now = settle(small.where("hi <> lo").distinct())
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
