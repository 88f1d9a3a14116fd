"""Transitive closures of one predicate's edges, by frontiers.

``edges`` is (``s``, ``o``).  A round follows several hops in one plan, removes
what was reached before, and writes the new nodes with the hop that reached
them first to the shared folder; only those of its last hop are followed on,
and where there are none the closure is complete.  Edges are written once,
distinct, since every hop reads them; ``kept_edges`` makes the table that
several closures share.  The start is not taken as reached: with ``+`` it is
in the result only if a cycle leads back to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from triplewright.storage import stored

#: Hops in one round: fewer jobs for deep graphs, at the cost of following some nodes again within a round.
HOPS = 4
#: Rounds after which what was reached is written anew as one table, so that plans don't grow with the depth.
COMPACT = 8


def kept_edges(edges: DataFrame) -> DataFrame:
    """A predicate's edges as a kept adjacency table: (``s``, ``o``), distinct, written once, for closures in either direction."""
    return stored(edges.where("s is not null and o is not null").select("s", "o").distinct())


def _loop(first: DataFrame, step, key: list[str]) -> DataFrame:
    seen, frontier, rounds = None, first, 0
    while True:
        layers, layer = [], frontier
        for k in range(HOPS):
            layer = step(layer).distinct()
            layers.append(layer.withColumn("__hop", F.lit(k + 1)))
        found = reduce(DataFrame.unionByName, layers).groupBy(*key).agg(F.min("__hop").alias("__hop"))
        new = stored(found if seen is None else found.join(seen, key, "left_anti"))
        seen = new.select(*key) if seen is None else seen.unionByName(new.select(*key))
        frontier, rounds = new.where(F.col("__hop") == HOPS).select(*key), rounds + 1
        if frontier.isEmpty():
            return seen
        if rounds % COMPACT == 0:
            seen = stored(seen)


def _hop(edges: DataFrame, backward: bool, kept: bool) -> DataFrame:
    here, there = ("o", "s") if backward else ("s", "o")
    return (edges if kept else kept_edges(edges)).select(F.col(here).alias("node"), F.col(there).alias("to"))


def reach(edges: DataFrame, starts: DataFrame, reflexive: bool = False, backward: bool = False, kept: bool = False) -> DataFrame:
    """Nodes reached from any of ``starts`` (``node``) in one step or more: (``node``), each once.

    ``reflexive`` adds the starts themselves, with or without edges;
    ``backward`` follows edges from object to subject; ``kept`` says that the
    edges come from ``kept_edges``.  Null ends are ignored; no starts or no
    edges reach nothing.
    """
    hop = _hop(edges, backward, kept)
    starts = starts.select("node").where("node is not null").distinct()
    out = _loop(starts, lambda f: f.join(hop, "node").select(F.col("to").alias("node")), ["node"])
    return out.unionByName(starts).distinct() if reflexive else out


def reach_pairs(edges: DataFrame, starts: DataFrame | None = None, reflexive: bool = False, backward: bool = False, kept: bool = False) -> DataFrame:
    """For each start the nodes that it reaches: (``start``, ``node``), each pair once.

    Without ``starts``, every node that has an edge in that direction is one.
    """
    hop = _hop(edges, backward, kept)
    starts = (hop.select("node") if starts is None else starts.select("node").where("node is not null")).distinct()
    first = starts.select(F.col("node").alias("start"), "node")
    out = _loop(first, lambda f: f.join(hop, "node").select("start", F.col("to").alias("node")), ["start", "node"])
    return out.unionByName(first).distinct() if reflexive else out


def intersect(closures: list[DataFrame]) -> DataFrame:
    """Nodes that are in every closure, by semi-joins."""
    out = closures[0]
    for other in closures[1:]:
        out = out.join(other, "node", "left_semi")
    return out
