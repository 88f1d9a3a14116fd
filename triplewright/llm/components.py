"""Connected components of a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triplewright.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (``u``, ``v``, integers) the least node that it reaches: (``node``, ``component``).

    Large-star and small-star steps alternate until nothing changes; every
    node then points at its component's least.  A step is one aggregation and
    one join on the node, so a node of very many edges is split like any
    skewed key, and rounds grow with the logarithm of the nodes.  Each round
    is written to the shared folder, which cuts the lineage.  Loops are
    ignored, repeated edges count once, no edges give no rows.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stored(small)
        before, state = state, _state(now)
        discard(last)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
