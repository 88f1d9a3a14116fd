"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of LZ78: each is the shortest string not yet
in the dictionary that the text itself builds up.  The hashes of the phrase set
are kept as minimum-hash signatures (one permutation, 64 bins, empty bins
filled from the next), so the share of equal bins estimates how much of two
texts' dictionaries is common, as a compressor that had read one text would
find it in the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from triplewright.llm.common import arrow_map, session, shuffle_partitions, small_table, stored
from triplewright.llm.textops import U64, mix64, span_hashes

BINS = 64
EMPTY = np.uint16(0)
#: Bytes of text that a range of neighbours holds, about.
RANGE_BYTES = 16 << 20
#: Ranges whose first documents are found by a broadcast; more are found by a shuffle.
BROADCAST_RANGES = 50_000


def parse(data: bytes, table: dict[int, int], node: int, cuts: list[int], base: int = 0) -> int:
    """Go on with a parse: phrases end at ``cuts``; returns the node reached within the last phrase.

    ``table`` maps a node and a byte to the node below; a node is a multiple
    of 256, the root is 0.
    """
    get, add = table.get, cuts.append
    new = (len(table) + 1) << 8
    for at, byte in enumerate(data, base + 1):
        key = node + byte
        node = get(key)
        if node is None:
            table[key] = new
            new += 256
            add(at)
            node = 0
    return node


def signatures(parts: list[tuple[bytes, list[int]]]) -> np.ndarray:
    """The signature of each parsed text: ``BINS`` 16-bit values, 0 throughout for an empty text."""
    out = np.zeros((len(parts), BINS), np.uint16)
    if not parts:
        return out
    data = np.frombuffer(b"".join(d for d, _ in parts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(d) for d, _ in parts])])
    counts = np.array([len(c) for _, c in parts])
    ends = np.fromiter((c for _, cuts in parts for c in cuts), np.int64, int(counts.sum())) + np.repeat(at[:-1], counts)
    own = np.repeat(np.arange(len(parts)), counts)
    starts = np.concatenate([[0], ends[:-1]])
    starts = np.maximum(starts, at[:-1][own])  # a text's first phrase begins with it
    h = span_hashes(data, starts, ends, fold=False)
    # of each text and bin the least hash: one sort over (text, bin, value)
    for first in range(0, len(parts), 4096):
        rows = slice(*np.searchsorted(own, [first, min(first + 4096, len(parts))]))
        keys = np.sort(((own[rows] - first).astype(U64) << U64(52)) | (h[rows] >> U64(12)))
        group = keys >> U64(46)
        head = np.flatnonzero(np.diff(group, prepend=~U64(0)))
        text, slot = (group[head] >> U64(6)).astype(np.int64), (group[head] & U64(63)).astype(np.int64)
        value = (mix64(keys[head] & U64((1 << 46) - 1)) >> U64(48)).astype(np.uint16)
        out[first + text, slot] = np.maximum(value, 1)
    # fill empty bins from the next filled one, changed by the distance
    some = (out != 0).any(1)
    filled, distance = out.copy(), np.zeros(out.shape, np.uint16)
    for _ in range(BINS - 1):
        gaps = (filled == 0) & some[:, None]
        if not gaps.any():
            break
        moved, far = np.roll(filled, -1, 1), np.roll(distance, -1, 1) + 1
        filled[gaps], distance[gaps] = moved[gaps], far[gaps]
    return np.where(some[:, None], np.maximum(filled ^ (distance * np.uint16(0x9E37)), 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins: 1 for equal texts, and for two empty ones."""
    return (a == b).mean(1)


def show(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def parsed(text: bytes) -> tuple[bytes, list[int]]:
    """A whole text and its phrases' ends; the last phrase may repeat an earlier one."""
    cuts: list[int] = []
    if parse(text, {}, 0, cuts):
        cuts.append(len(text))
    return text, cuts


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``fingerprint`` of each row; no shuffle.  A null text is empty; equal texts have equal fingerprints."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            prints = [show(s) for s in signatures([parsed(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_column, "fingerprint"])

    return arrow_map(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, fingerprint string")


def with_range(docs: DataFrame, id_column: str, cuts: list[int]) -> DataFrame:
    """``docs`` with ``__range``: how many of the ascending ``cuts`` the id reaches; null ids are in range -1."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(0).to_numpy(np.int64), "right").astype(np.int32))

    return docs.withColumn("__range", F.when(F.col(id_column).isNull(), F.lit(-1)).otherwise(range_of(F.col(id_column))))


def compare_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint against an edited copy's and its neighbour's.

    Documents are neighbours in descending order of their integer id (ties by
    the text's hash; null ids last); the last one's next is the first.  The
    edited text is the text with its last ``floor(n_chars / 2)`` code points
    replaced by the first as many, or all, of the next document's.  Returns the
    id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    Texts move once: the ids' quantiles cut the order into ranges of about
    ``RANGE_BYTES``, and each range also gets a copy of the document that comes
    next after it, one a range.  A range streams through its task, which holds
    two documents and one Arrow batch of results.  The parse of the first half
    is shared by the text and its edited copy.

    A null text is empty; an empty text's edited text is empty, and two empty
    fingerprints have likeness 1.  Repeated rows are documents each; other
    columns don't matter; a single document is its own next; an empty table
    gives an empty result.  Rows of one id stay in one range.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    whole = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    whole = whole.withColumn("h", F.xxhash64("text"))
    light = stored(whole.select("id", "h", F.octet_length("text").alias("bytes")))
    total = light.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = max(1, (total["bytes"] or 0) // RANGE_BYTES, min(shuffle_partitions(spark), total["n"] // 64))
    cuts: list[int] = []
    if ranges > 1:
        found = light.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    # the first document of each range in the order; it comes next after the range above
    first = with_range(light, "id", cuts).groupBy("__range").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "h")).alias("x"))
    tops = [(r["__range"], r["x"]["id"], r["x"]["h"]) for r in first.orderBy("__range").collect()]
    heads = [(tops[k - 1][1], tops[k - 1][2], tops[k][0]) for k in range(len(tops))]
    head_table = small_table(spark, dict(zip(("__id", "__h", "__to"), map(list, zip(*heads)))) if heads else {"__id": [], "__h": [], "__to": []}, "__id long, __h long, __to int")
    head_table = F.broadcast(head_table) if len(heads) <= BROADCAST_RANGES else head_table
    extra = whole.join(head_table, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("id", "text", "h", F.col("__to").alias("__range")).dropDuplicates(["__range"])
    rows = with_range(whole, "id", cuts).withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    ordered = rows.repartitionById(len(cuts) + 2, F.col("__range") + 1).sortWithinPartitions("__range", "extra", F.col("id").desc_nulls_last(), F.col("h").desc())
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        waiting = None  # a document whose next has not come: id, its text, its range

        def finish(group):
            """Results of (id, text, next text) triples."""
            own, edited, following, sha, sizes = [], [], [], [], []
            for _, text, after in group:
                n = len(text)
                half = n // 2
                head, tail = text[: n - half].encode("utf-8", "replace"), text[n - half :].encode("utf-8", "replace")
                other = after[:half].encode("utf-8", "replace")
                table: dict[int, int] = {}
                cuts: list[int] = []
                node = parse(head, table, 0, cuts)
                cuts2, table2 = cuts.copy(), table.copy()
                for more, to, words in ((tail, cuts, table), (other, cuts2, table2)):
                    if parse(more, words, node, to, len(head)):
                        to.append(len(head) + len(more))
                own.append((head + tail, cuts))
                edited.append((head + other, cuts2))
                sha.append(hashlib.sha256(head + other).hexdigest())
                sizes.append(n)
                following.append(after)
            a, b = signatures(own), signatures(edited)
            # the next document's print is the next row's, but at the end of a group
            last = signatures([parsed(following[-1].encode("utf-8", "replace"))])
            same = [group[k + 1][1] is group[k][2] for k in range(len(group) - 1)]
            c = np.concatenate([a[1:], last])
            for k, joined in enumerate(same):
                if not joined:
                    c[k] = signatures([parsed(following[k].encode("utf-8", "replace"))])[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sha), pa.array([show(s) for s in a]), pa.array([show(s) for s in b]), pa.array(likeness(a, b)), pa.array(likeness(a, c))],
                names=["id", *names[1:]],
            )

        group, held = [], 0
        for batch in batches:
            for k, text, where, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if waiting is not None:
                    group.append((waiting[0], waiting[1], text))
                    held += len(waiting[1])
                    if held > 1 << 20 or len(group) >= 2000:
                        yield finish(group)
                        group, held = [], 0
                waiting = None if more else (k, text, where)
        if group:
            yield finish(group)

    out = arrow_map(ordered.select("id", "text", "h", "__range", "extra"), run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("id").cast(kind).alias(id_column), *names[1:])
