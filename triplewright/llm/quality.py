"""A quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from triplewright.llm.common import arrow_map, crc_fold, session, stored
from triplewright.llm.textops import U64, Texts, as_texts, char_counts, find_words, mix64, slices

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "marks", "distinct_words",
    "same_as_before", "bare_marks", "symbol_words", "line_words", "repeated_lines", "top_word", "wide_bytes", "long_words",
)

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_LETTER[0xC3:] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[*b"!#$%&*+/<=>@\\^_`{|}~"]] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[[*b".,;:?!'\"()-"]] = 1


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and the count of the most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    keys = np.sort(owner.astype(U64) << U64(44) | h >> U64(20))
    head = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    own = (keys[head] >> U64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.append(head, len(keys))))
    return np.bincount(own, minlength=n).astype(float), most


def statistics(texts: Texts) -> np.ndarray:
    """The transformed statistics of each text, all finite; an empty text has zero counts and shares."""
    data, offsets = texts
    n = len(texts)
    words = find_words(texts)
    counts = words.counts().astype(float)
    some = np.maximum(counts, 1)
    lengths = (words.ends - words.starts).astype(float)
    owner = np.repeat(np.arange(n), words.counts())
    h = words.hashes()
    chars = char_counts(texts).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    mean = _sums(lengths, words.first) / some
    spread = np.sqrt(np.maximum(_sums(lengths**2, words.first) / some - mean**2, 0))
    letters = np.maximum(_sums(_LETTER[data], offsets), 1)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct, most = _distinct(owner, h, n)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    in_word = symbol[words.ends] - symbol[words.starts]
    # lines: a hash is the sum of its words' hashes by place
    line_end = np.flatnonzero(data == 10)
    line_of = np.searchsorted(line_end, words.starts)
    starts_line = np.ones(len(h), bool)
    if len(h) > 1:
        starts_line[1:] = (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])
    line_first = np.flatnonzero(starts_line)
    running = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(0x51ED27)), dtype=U64)])
    line_hash = mix64(running[np.append(line_first[1:], len(h))] - running[line_first]) if len(h) else h
    lines = np.bincount(owner[line_first], minlength=n).astype(float)
    line_distinct, _ = _distinct(owner[line_first], line_hash, n)
    share = lambda x: np.sqrt(np.maximum(x, 0))
    columns = [
        np.log1p(chars), np.log1p(counts), np.log1p(mean), np.log1p(spread), share(_sums(_UPPER[data], offsets) / letters), share(_sums(_DIGIT[data], offsets) / size),
        share(_sums(_SYMBOL[data], offsets) / size), share(_sums(_MARK[data], offsets) / size), np.log((distinct + 1) / (counts + 1)), share(_sums(same, words.first) / some),
        share(_sums((lengths <= 3) & (in_word == lengths), words.first) / some), share(_sums(in_word > 0, words.first) / some), np.log1p(counts / np.maximum(lines, 1)),
        share(1 - line_distinct / np.maximum(lines, 1)) * (lines > 0), share(most / some), share(_sums(data >= 128, offsets) / size), share(_sums(lengths > 24, words.first) / some),
    ]
    return np.stack(columns, 1)


#: Words at which a text's own statistics count as much as the average ones.
HALF_TRUST = 30


def trusted(x: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """The statistics without the two sizes, drawn to ``neutral`` as a text has few words: shares of a few words say little."""
    n = np.expm1(x[:, 1:2])
    return neutral + (x[:, 2:] - neutral) * (n / (n + HALF_TRUST))


class Discriminant(NamedTuple):
    """Two Gaussians: means, inverse Cholesky factors, log-determinants with log-priors; and what brings statistics to their scale."""

    neutral: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1."""
        z = (trusted(x, self.neutral) - self.centre) / self.scale
        # Mahalanobis distances by the cached factors
        d = [(((z - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors)]
        gap = (self.constants[1] - d[1] / 2) - (self.constants[0] - d[0] / 2)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(neutral: np.ndarray, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.05) -> Discriminant:
    """The discriminant from each class's count, sum and sum of outer products.

    Each class's covariance is shrunk towards the pooled one by ``to_pooled``,
    more for a class with few rows, then towards its diagonal by
    ``to_diagonal``.  A class without rows gets the pooled mean, covariance and
    half a row's weight.
    """
    k = sums.shape[1]
    total = counts.sum()
    centre = sums.sum(0) / max(total, 1)
    spread = np.sqrt(np.maximum(np.diag(squares.sum(0)) / max(total, 1) - centre**2, 1e-6))
    means, covariances = np.zeros((2, k)), np.zeros((2, k, k))
    for c in range(2):
        if counts[c]:
            m = sums[c] / counts[c]
            means[c] = (m - centre) / spread
            covariances[c] = (squares[c] / counts[c] - np.outer(m, m)) / np.outer(spread, spread)
    pooled = (counts[:, None, None] * covariances).sum(0) / max(total, 1) + 1e-3 * np.eye(k)
    factors, constants = [], []
    for c in range(2):
        a = min(1.0, to_pooled + k / (counts[c] + k))
        s = (1 - a) * covariances[c] + a * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s))
        root = np.linalg.cholesky(s + 1e-4 * np.eye(k))
        factors.append(np.linalg.solve(root, np.eye(k)))
        constants.append(np.log((counts[c] + 0.5) / (total + 1)) - np.log(np.diag(root)).sum())
    return Discriminant(neutral, centre, spread, means, np.array(factors), np.array(constants))


def with_statistics(docs: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and ``statistics``, an array; a null text is empty."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            column = batch.column(len(columns))
            for a, b in slices(column):
                x = statistics(as_texts(column.slice(a, b - a)))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(columns))), flat], names=[*columns, "statistics"])

    return arrow_map(docs.select(*columns, text_column), run, f"{fields}, statistics array<double>")


def learn(statistics_table: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Discriminant:
    """Fit on all rows that have a label and whose fold (crc32 of the id, modulo 5) isn't 0.

    What each partition adds up - a count, sums and products of the statistics
    by class - is added up by place with map-side combining; the driver gets
    some hundred numbers, whatever the input.
    """
    k = len(NAMES) - 2
    known = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column).alias("__id"), (F.col(label_column) > 0).cast("int").alias("__y"))
    rows = statistics_table.where(crc_fold(id_column) != 0).join(known, F.col(id_column) == F.col("__id")).select("__y", "statistics")
    means = rows.select(F.posexplode("statistics")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()
    neutral = np.zeros(k)
    for r in means:
        if r["pos"] >= 2:
            neutral[r["pos"] - 2] = r["mean"]

    def run(batches):
        counts, sums, squares = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = trusted(np.asarray(batch.column(1).flatten()).reshape(-1, k + 2), neutral)
            for c in range(2):
                own = x[y == c]
                counts[c] += len(own)
                sums[c] += own.sum(0)
                squares[c] += own.T @ own
        if counts.any():
            flat = np.concatenate([counts, sums.ravel(), squares.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "value"])

    found = arrow_map(rows, run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(2 + 2 * k + 2 * k * k)
    for r in found:
        flat[r["place"]] = r["value"]
    return fit(neutral, flat[:2], flat[2 : 2 + 2 * k].reshape(2, k), flat[2 + 2 * k :].reshape(2, k, k))


def score(statistics_table: DataFrame, model: Discriminant, columns: list[str]) -> DataFrame:
    """``columns`` and ``score`` (0 to 1) of a table with ``statistics``."""
    fields = ", ".join(f"`{c}` {statistics_table.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(len(columns)).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(model.score(x))], names=[*columns, "score"])

    return arrow_map(statistics_table.select(*columns, "statistics"), run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Every document's quality: the id, ``held_out``, ``score`` and ``predicted``.

    Texts are read once, into a table of statistics that the fit and the
    scores both use; only ids, labels and statistics are shuffled, for the
    join with the labels.  Labels are read from folds 1 to 4 alone
    (``held_out`` marks fold 0) and decide nothing but the fit.

    A null text is empty and scored like one; repeated ids and label rows count
    each in the fit; null ids are in fold crc32('') mod 5 and match no label;
    other columns don't matter.  Without any label the score is one constant;
    an empty table gives an empty result.
    """
    session(docs.sparkSession)
    table = stored(with_statistics(docs, [id_column], text_column))
    model = learn(table, labels, id_column, label_column)
    scored = score(table, model, [id_column])
    return scored.select(id_column, (crc_fold(id_column) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The rows and columns of ``docs`` whose score reaches ``threshold``.

    Each text is read once: its row is written with its statistics, of which
    the fit reads the ids and numbers alone, and the scores filter the written
    rows in their partitions.  No text is shuffled.

    A null text is scored as an empty one and stays null if it is kept;
    repeated rows are each kept or not, alike; null ids match no label; other
    columns are passed on, and none may be called ``__statistics``; an empty
    table gives an empty result.
    """
    session(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_column)

    def with_own(batches):
        for batch in batches:
            for a, b in slices(batch.column(at)):
                x = statistics(as_texts(batch.column(at).slice(a, b - a)))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, flat], names=[*names, "__statistics"])

    table = stored(arrow_map(docs, with_own, StructType([*docs.schema.fields, StructField("__statistics", ArrayType(DoubleType()))])))
    model = learn(table.select(id_column, F.col("__statistics").alias("statistics")), labels, id_column, label_column)

    @F.pandas_udf("boolean")
    def good(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.tolist())) >= threshold) if len(x) else pd.Series([], dtype=bool)

    return table.where(good("__statistics")).select(*names)
