"""Connected components of an edge table, by alternating stars (Kiveris et al. 2014); edges never leave the executors.

Defined results: repeated edges and edges from a node to itself change nothing; an edge with a null end is left out; no
edges give no nodes; nodes without an edge are not in the result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """a, b -> node, component (the smallest node reachable), for nodes with an edge.

    A star's minimum is pre-aggregated in each task. Every round writes the edges out, so a lost executor costs one round.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        #: large star: what lies above a node hangs on the least of its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        #: small star: a node and what lies below it hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, edges = edges, settle(small)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
