"""Connected components of an edge table by alternating large and small stars, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.scratch import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(v, least) for every pair (u, v), least being the smallest of u and what u meets."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return pairs.join(materialize(least, "least"), "u")  # stored, so that the join can split a hub's rows


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it can reach. Nulls and loops are left out.

    Large star: a node's larger neighbours meet the smallest node near it. Small star: its smaller neighbours do. Both are
    an aggregation and a join; edges to one node aren't collected. The edges become stars in a logarithmic number of
    rounds; the result is stored when a round changes nothing.
    """
    now = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = tuple(state)
        both = now.union(now.select("v", "u"))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        small = _star(large)
        now = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", "least")).filter("u > v").distinct()
        now = materialize(now, "edges")
