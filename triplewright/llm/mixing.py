"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are cut into equal blocks of a pseudo-random key space,
anew for each pass over the source.  How many blocks a source gives to the mix,
its quota, follows from its target; a tree divides these exact quotas among
output shards, each node by one multivariate hypergeometric draw, so that a
shard's share of every source is what a random permutation of all blocks would
give.  Along each source's permuted blocks the shards draw disjoint runs, and a
document is taken as often as a shard draws one of its blocks.  A node's draw
depends on the seed and the node alone, so any task can follow the tree by
itself: nothing is gathered to place a document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from triplewright.llm.common import small_table, stored

WORDS = r"[^\x20\x09-\x0D]+"
KEY_BITS = 63
#: Sources up to this number are mapped by a broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Blocks of all sources and passes at most: the draws take fewer than 10^9.
MOST_BLOCKS = 900_000_000
#: Numbers that a worker keeps of the draws that it has made.
CACHED = 4_000_000


def word_count(text) -> F.Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...], most: float = 3.0) -> list[float]:
    """Each source's target: its weight's share of all sizes, ``most`` times its own size at most.

    What is above goes to the other sources by weight, until none is above.
    Weights repeat along the sources.  A source without words has none.
    """
    total, n = float(sum(sizes)), len(sizes)
    weight = [float(weights[k % len(weights)]) for k in range(n)]
    fixed: dict[int, float] = {}
    while len(fixed) < n:
        left = total - sum(fixed.values())
        share = sum(weight[k] for k in range(n) if k not in fixed)
        above = [k for k in range(n) if k not in fixed and left * weight[k] / share > most * sizes[k]]
        if not above:
            return [fixed[k] if k in fixed else left * weight[k] / share for k in range(n)]
        fixed |= {k: most * sizes[k] for k in above}
    return [fixed[k] for k in range(n)]


class Mix(NamedTuple):
    """What places a document: by source the blocks that it gives, along all its passes."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    quotas: list[int]
    passes: int
    shards: int
    block_bits: int
    seed: int


_DRAWN: dict[tuple, tuple[int, ...]] = {}


def _left(seed: int, lo: int, hi: int, quota: tuple[int, ...]) -> tuple[int, ...]:
    """What the left half of shards ``lo:hi`` draws of the node's blocks."""
    key = (seed, lo, hi, hash(quota), sum(quota))
    if key not in _DRAWN:
        if len(_DRAWN) * len(quota) > CACHED:
            _DRAWN.clear()
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        drawn = rng.multivariate_hypergeometric(np.array(quota, np.int64), sum(quota) * ((hi - lo) // 2) // (hi - lo), method="marginals")
        _DRAWN[key] = tuple(drawn.tolist())
    return _DRAWN[key]


def place(source: np.ndarray, block: np.ndarray, quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard that draws each (source, permuted block position); -1 where the quota doesn't reach and none does."""
    out = np.full(len(source), -1, np.int64)
    inside = np.flatnonzero(block < quota[source]) if len(source) else np.zeros(0, np.int64)
    stack = [(0, shards, tuple(quota.tolist()), inside, block[inside].astype(np.int64))]
    while stack:
        lo, hi, own, rows, at = stack.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows] = lo
            continue
        left = _left(seed, lo, hi, own)
        edge = np.array(left, np.int64)[source[rows]]
        goes = at < edge
        middle = lo + (hi - lo) // 2
        stack.append((lo, middle, left, rows[goes], at[goes]))
        stack.append((middle, hi, tuple(a - b for a, b in zip(own, left)), rows[~goes], (at - edge)[~goes]))
    return out


def _block(id_column: str, hash_column: str, seed: int, number, bits: int) -> F.Column:
    """The permuted block, of ``2^bits``, that a document is in for one pass over its source."""
    key = F.xxhash64(F.lit(seed), number, F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(id_column).isNull(), F.col(hash_column))
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _by_source(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    table = small_table(spark, columns, schema)
    return F.broadcast(table) if len(next(iter(columns.values()))) <= BROADCAST_SOURCES else table


def plan(sized: DataFrame, weights: tuple[float, ...], most: float = 3.0, seed: int = 0, shards: int | None = None) -> Mix:
    """Decide the mix from a table of (``id``, ``source``, ``size``, ``h``).

    Only sums by source reach the driver: one row a source.  A source gives
    all blocks of its full passes, and of the pass after them the first blocks
    whose words together come nearest to what the target still wants.
    """
    spark = sized.sparkSession
    by_source = sorted(sized.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    names, sizes = [r["source"] for r in by_source], [int(r["n"]) for r in by_source]
    goal = targets(sizes, weights, most)
    total, passes = sum(sizes), max(1, int(np.ceil(most)))
    shards = shards or max(1, -(-total // 16_000_000), min(64, -(-total // 100_000)))
    bits = int(np.clip(np.ceil(np.log2(64 * shards / max(1, len(names)))), 10, 24))
    bits = max(0, min(bits, int(np.log2(MOST_BLOCKS / (passes * max(1, len(names)))))))
    full = [int(min(t // size, most)) if size else 0 for size, t in zip(sizes, goal)]
    need = [t - f * size if size and f < most else 0.0 for size, t, f in zip(sizes, goal, full)]
    quotas = [f << bits for f in full]
    some = [k for k, x in enumerate(need) if x > 0]
    if some:
        open_ = _by_source(spark, {"__s": some, "__name": [names[k] for k in some], "__pass": [full[k] for k in some], "need": [need[k] for k in some]}, "__s int, __name string, __pass int, need double")
        words = sized.join(open_, F.col("source").eqNullSafe(F.col("__name"))).groupBy("__s", "need", _block("id", "h", seed, F.col("__pass"), bits).alias("block")).agg(F.sum("size").alias("n"))
        upto = words.withColumn("gap", F.abs(F.sum("n").over(Window.partitionBy("__s").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("need")))
        for r in upto.groupBy("__s").agg(F.min(F.struct("gap", "block")).alias("x")).collect():
            if r["x"]["gap"] < need[r["__s"]]:  # else no block is nearer
                quotas[r["__s"]] += r["x"]["block"] + 1
    return Mix(names, sizes, goal, quotas, passes, shards, bits, seed)


def with_mix(docs: DataFrame, mix: Mix, id_column: str, source_column: str, hash_column: str) -> DataFrame:
    """``docs`` with ``__source_size``, ``__target`` and ``__shards``: for each time that a document is taken the shard that draws it."""
    columns = {"__s": list(range(len(mix.names))), "__name": mix.names, "__source_size": mix.sizes, "__target": [float(t) for t in mix.targets]}
    table = _by_source(docs.sparkSession, columns, "__s int, __name string, __source_size long, __target double")
    out = docs.join(table, F.col(source_column).cast("string").eqNullSafe(F.col("__name")), "left").drop("__name")
    at = [_block(id_column, hash_column, mix.seed, F.lit(e), mix.block_bits) + F.lit(e << mix.block_bits) for e in range(mix.passes)]
    quota, shards, seed, passes = np.array(mix.quotas, np.int64), mix.shards, mix.seed, mix.passes

    @F.pandas_udf("array<int>")
    def shards_of(source: pd.Series, position: pd.Series) -> pd.Series:
        if not len(source):
            return pd.Series([], dtype=object)
        flat = np.concatenate(position.tolist()).astype(np.int64)
        drawn = place(np.repeat(source.to_numpy(np.int64), passes), flat, quota, shards, seed).astype(np.int32).reshape(-1, passes)
        return pd.Series([row[row >= 0] for row in drawn])

    return out.withColumn("__shards", shards_of(F.col("__s"), F.array(*at))).drop("__s")


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The table of (``id``, ``source``, ``size`` in words, ``h``) that a plan is made from, written once."""
    text = F.col(text_column)
    return stored(docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h")))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 0, shards: int | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The mixed documents: all columns of ``docs``, a row for each copy taken, shuffled.

    Sources in code point order (null last) have ``weights``, repeating, and
    share the words of all documents; a target stops at ``most`` times its
    source's words.  The tree draws blocks of documents for every shard; a
    shard is one partition's run, ordered by random keys.

    One shuffle moves the documents to their shards, whose sizes don't depend
    on how large a source is.  Reruns give the same rows.  Rows that repeat an
    id and a text share their blocks and are taken alike; null ids are told
    apart by their texts; null sources are a source; null or empty texts have
    no words and are taken with the blocks of their source; an empty table
    gives an empty mix.  Other columns are passed on; none may be called
    ``__copy``, ``__shard``, ``__shards``, ``__h``, ``__source_size`` or ``__target``.
    """
    mix = plan(sized(docs, id_column, source_column, text_column), weights, most, seed, shards)
    placed = with_mix(docs.withColumn("__h", F.xxhash64(text_column)), mix, id_column, source_column, "__h").where(F.size("__shards") > 0)
    copies = placed.select(*docs.columns, "__h", F.posexplode("__shards").alias("__copy", "__shard"))
    order = F.xxhash64(F.lit(seed), F.lit(1), F.col(id_column), F.col("__h"), F.col("__copy"))
    return copies.repartitionById(mix.shards, F.col("__shard")).sortWithinPartitions("__shard", order).select(*docs.columns)


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 0, shards: int | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """For each document of ``docs`` what the mix takes of it.

    Returns the id, ``size``, ``source_size``, ``target`` (its source's),
    ``taken`` (words, repeats counted), ``copies`` and ``shards`` (one for each
    copy).  The same decisions as ``mix_documents``, without moving a text.
    """
    table = sized(docs, id_column, source_column, text_column)
    mix = plan(table, weights, most, seed, shards)
    out = with_mix(table, mix, "id", "source", "h")
    return out.select(F.col("id").alias(id_column), "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.size("__shards") * F.col("size")).alias("taken"), F.size("__shards").alias("copies"), F.col("__shards").alias("shards"))
