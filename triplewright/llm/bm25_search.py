"""Exact top-k search with BM25: inverted shards, block-max pruning, exact merging.

Queries are taken in blocks of bounded size.  For each block the documents are
read twice, to count its terms and to score: a task cuts its documents into
shards, inverts each for the block's terms, and bounds what each query can
score in each run of documents.  Queries whose k-th best so far no run can
reach are skipped, the others are scored in single precision, and what may be
among the best is scored again in double, with idf and lengths of the whole
corpus, so the tasks' lists merge exactly.  Where there is much to score, the
k-th best of a sample of the documents is what a list must reach at first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from triplewright.llm.common import arrow_map, session
from triplewright.llm.textops import U64, as_texts, find_words, slices

K1, B = 1.2, 0.75
#: Queries of a block at most, and bytes of their texts.
BLOCK_QUERIES, BLOCK_BYTES = 16_384, 96 << 20
#: Documents of a run, and text bytes of a shard.
RUN, SHARD_BYTES = 64, 8 << 20
#: Terms in more than this share of a shard are scored as dense columns.
DENSE = 0.05
#: From so many pairs of query and document, one document in so many is searched first, for a score to reach.
SAMPLE_FROM, SAMPLE = 1 << 28, 32
#: Documents of the sample in a task, about: each gives k rows a query.
SAMPLE_TASK = 4096
#: Queries scored at once, and candidates of theirs.
PART, PAIRS = 128, 4096


class Places:
    """Finds hashes in a sorted array of them: their first bits say where to look."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(1, (2 * len(known)).bit_length())
        self.shift = U64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((known >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end, out = self.first[bucket], self.first[bucket + 1], np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.known[at] == h
            out[todo[hit]] = at[hit]
            at += 1
            left = np.flatnonzero(~hit & (at < end))
            todo, at, end, h = todo[left], at[left], end[left], h[left]
        return out


def _terms(column: pa.Array, known: Places | None = None):
    """(first row, owner, term, times, lengths) of each slice: the distinct terms of each text, as hashes or places in ``known``."""
    for a, b in slices(column, SHARD_BYTES):
        found = find_words(as_texts(column.slice(a, b - a)))
        h, lengths = found.hashes(), found.counts()
        owner = np.repeat(np.arange(b - a), lengths)
        if known is not None:
            at = known.find(h)
            hit = at >= 0
            both = np.sort(owner[hit] << 32 | at[hit])
            owner, h = both >> 32, both & 0xFFFFFFFF
        else:
            by = np.lexsort((h, owner))
            owner, h = owner[by], h[by]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        yield a, owner[head], h[head], np.diff(np.append(head, len(h))), lengths


class Queries:
    """A block of queries over its sorted terms; query q has terms ``term[edge[q]:edge[q + 1]]`` of weight ``weight``."""

    def __init__(self, ids: list, texts: list[np.ndarray], terms: np.ndarray):
        self.ids, self.terms = ids, terms
        self.term = np.searchsorted(terms, np.concatenate([np.zeros(0, U64), *texts])).astype(np.int32)
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.idf = np.zeros(len(terms))

    def __len__(self) -> int:
        return len(self.ids)


class Best:
    """The k best documents of each query so far: by score, then by the least id; ``floor``: what each query's must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, floor
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def threshold(self) -> np.ndarray:
        return self.scores[:, -1] if self.floor is None else np.maximum(self.scores[:, -1], self.floor)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take some more documents, each with the query it is for."""
        own = np.unique(query)
        q = np.concatenate([np.repeat(own, self.k), query])
        s = np.concatenate([self.scores[own].ravel(), scores])
        d = np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], own)
        top = order[first[:, None] + np.arange(self.k)]
        self.scores[own], self.ids[own] = s[top], d[top]


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begin[k]`` to ``begin[k] + sizes[k]`` of all k, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(queries: Queries, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, ids: np.ndarray, best: Best, digits: int) -> int:
    """Score a shard of ``n`` documents for all queries that may gain from it; returns the (query, run) pairs scored in full.

    Rare terms' lists are added up first; frequent terms follow as a product,
    for the queries where those sums and the frequent terms' block maxima can
    reach the k-th best.  The product is single-precision; what it can't rule
    out is added up again in double.
    """
    runs = -(-n // RUN)
    width = runs * RUN
    by = np.argsort(term, kind="stable")
    owner, term = owner[by], term[by]
    impact = impact[by] * queries.idf[term]
    if not len(term):
        return 0
    edge = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
    local, size = term[edge[:-1]], np.diff(edge)  # the shard's lists
    place = np.full(len(queries.terms), -1, np.int32)
    place[local] = np.arange(len(local))
    at = place[queries.term]
    has = np.flatnonzero(at >= 0)
    q_edge = np.searchsorted(has, queries.edge)
    at = at[has]
    dense = np.flatnonzero(size > DENSE * n)
    slot = np.full(len(local), -1)
    slot[dense] = np.arange(len(dense))
    rows = _spread(edge[dense], size[dense])
    exact = np.zeros((width, len(dense)))
    exact[owner[rows], np.repeat(np.arange(len(dense)), size[dense])] = impact[rows]
    table = np.ascontiguousarray(exact.T, np.float32)
    top = table.reshape(len(dense), runs, RUN).max(2)  # block maxima: a list's greatest impact in each run of documents
    off, unit = (len(dense) + 8) * 2.0**-23, 10.0**-digits  # a sum of positive numbers is off by this share at most
    some, scored = np.flatnonzero(np.diff(q_edge)), 0
    for k in range(0, len(some), PART):
        part = some[k : k + PART]
        lo, hi = q_edge[part[0]], q_edge[part[-1] + 1]
        own, lists = np.repeat(np.arange(len(part)), q_edge[part + 1] - q_edge[part]), at[lo:hi]
        column = slot[lists]
        is_rare = column < 0
        rare, sizes = lists[is_rare], size[lists[is_rare]]
        index = _spread(edge[rare], sizes)
        cell = np.repeat(own[is_rare] * width, sizes)
        cell += owner[index]
        sums = np.bincount(cell, impact[index], len(part) * width).reshape(len(part), width)
        marks = np.zeros((len(part), len(dense)), np.float32)
        marks[own[~is_rare], column[~is_rare]] = 1
        floor = np.maximum((best.threshold()[part] - unit) * (1 - 2 * off), 0.4 * unit)
        may = sums.reshape(len(part), runs, RUN).max(2) + marks @ top >= floor[:, None]
        live = np.flatnonzero(may.any(1))
        if not len(live):
            continue
        scored += int(may.sum())
        if len(live) < len(part):
            part, sums, marks, floor = part[live], sums[live], marks[live], floor[live]
        scores = marks @ table
        scores += sums
        hit = scores >= floor[:, None].astype(np.float32)
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > best.k)
        if len(many):  # the k-th best of these is a threshold too
            kth = np.partition(scores[many], width - best.k, axis=1)[:, width - best.k].astype(np.float64)
            floor[many] = np.maximum(floor[many], (kth - unit) * (1 - 4 * off))
            hit[many] = scores[many] >= floor[many, None].astype(np.float32)
        q, d = np.nonzero(hit)
        for c in range(0, len(q), PAIRS):
            a, b = q[c : c + PAIRS], d[c : c + PAIRS]
            s = np.round(sums[a, b] + np.einsum("ij,ij->i", marks[a], exact[b]), digits)
            keep = np.flatnonzero((s > 0) & (s >= best.threshold()[part[a]]))
            if len(keep):
                best.add(part[a[keep]], s[keep], ids[b[keep]])
    return scored


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", query_id: str = "query_id", query_text: str = "text", digits: int = 6) -> DataFrame:
    """The ``k`` best documents for every query: ``query_id``, ``rank``, ``doc_id``, ``score``.

    BM25 with k1 1.2 and b 0.75, idf ``ln(1 + (N - df + 0.5) / (df + 0.5))``;
    words are runs between spaces, A-Z as a-z; each distinct word of a query
    counts once.  Whole texts on both sides.  Scores are rounded to ``digits``;
    ties go to the least id; documents that share no word aren't listed, so a
    query may have fewer than ``k`` rows, and one without words has none.

    What moves: by task and block of queries the terms' document counts, and
    at most ``k`` rows a query.  A block has ``BLOCK_QUERIES`` queries and about
    ``BLOCK_BYTES`` of text at most; that is what a task is sent.

    Null texts are empty but count as documents; rows without an id are counted
    but never listed; repeated rows are documents each; other columns don't
    matter; without queries or documents the result is empty.
    """
    spark = session(docs.sparkSession)
    if not 1 <= k:
        raise ValueError("k must be positive")
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.col(query_text).alias("text"))
    r = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = int(max(1, -(-r["n"] // BLOCK_QUERIES), -(-(r["bytes"] or 0) // BLOCK_BYTES)))

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    def terms_of(batches):
        for batch in batches:
            for a, owner, h, _, lengths in _terms(batch.column(1)):
                edge = np.searchsorted(owner, np.arange(len(lengths) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(lengths)), pa.array([h[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())], names=["qid", "terms"])

    out = []
    for block in range(blocks):
        rows = arrow_map(asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block), terms_of, "qid long, terms binary").collect()
        rows.sort(key=lambda r: r["qid"])
        texts = [np.frombuffer(r["terms"], U64) for r in rows]
        own = Queries([r["qid"] for r in rows], texts, np.unique(np.concatenate([np.zeros(0, U64), *texts])))
        del rows, texts
        known = spark.sparkContext.broadcast(own.terms)

        def count(batches, known=known):
            places = Places(known.value)
            df, documents, words = np.zeros(len(places.known), np.int64), 0, 0
            for batch in batches:
                for _, _, at, _, lengths in _terms(batch.column(0), places):
                    df += np.bincount(at, minlength=len(df))
                    documents, words = documents + len(lengths), words + int(lengths.sum())
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [documents, words]))], names=["at", "df"])

        counted = arrow_map(source.select("text"), count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
        at, n = counted["at"].to_numpy(np.int64), counted["df"].to_numpy(np.int64)
        n_docs, words = int(n[at == -1].sum()), int(n[at == -2].sum())
        df = np.zeros(len(own.terms))
        df[at[at >= 0]] = n[at >= 0]
        own.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        mean = max(words / max(1, n_docs), 1e-9)
        sent = spark.sparkContext.broadcast(own)

        def best_of(docs, floor=None, sent=sent, mean=mean):
            def run(batches):
                queries = sent.value
                places, best = Places(queries.terms), Best(len(queries), k, None if floor is None else floor.value)
                for batch in batches:
                    ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                    for a, owner, at, times, lengths in _terms(batch.column(1), places):
                        norm = K1 * (1 - B + B * lengths / mean)
                        impact = times * (K1 + 1) / (times + norm[owner])
                        impact[ids[a + owner] == np.iinfo(np.int64).min] = 0
                        search_shard(queries, owner, at, impact, len(lengths), ids[a : a + len(lengths)], best, digits)
                q, place = np.nonzero(np.isfinite(best.scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(queries.ids, np.int64)[q]), pa.array(best.ids[q, place]), pa.array(best.scores[q, place])], names=["qid", "id", "score"])

            return ranked(arrow_map(docs, run, "qid long, id long, score double"))

        if len(own) * n_docs < SAMPLE_FROM:
            out.append(best_of(source))
            continue
        sample = source.where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(SAMPLE)) == 0).repartition(max(spark.sparkContext.defaultParallelism, n_docs // SAMPLE // SAMPLE_TASK))
        reached = best_of(sample).where(F.col("rank") == k).select("qid", "score").toPandas()
        floor = dict(zip(reached["qid"].tolist(), reached["score"].tolist()))
        out.append(best_of(source, spark.sparkContext.broadcast(np.array([floor.get(q, -np.inf) for q in own.ids]))))
    found = reduce(DataFrame.unionByName, out)
    return found.select(F.col("qid").alias("query_id"), F.col("rank").cast("long"), F.col("id").alias("doc_id"), "score")
