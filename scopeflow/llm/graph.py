"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scopeflow.llm.storage import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the least node id reachable.

    Alternates two steps. Large star: each node sends its larger neighbours to the least of its neighbourhood. Small star: each node
    sends its smaller neighbours, and itself, there. Both keep components, and end in stars around the least ids. Every step's edges
    are written to the shared folder. Minima are taken by aggregation, so a node with very many neighbours is no burden.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), label)
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(down.select("hi", F.col("m").alias("lo")))
        seen = Observation()
        now = written(small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")), label)
        got = (seen.get["n"], seen.get["h"])
        if got == mark:
            break
        mark = got
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionAll(stars.select("component", "component").distinct().toDF("node", "component"))
