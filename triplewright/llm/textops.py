"""Vectorised text primitives that run inside Arrow batches.

The operators work on whole texts, many at a time: a batch of strings is seen
as one array of UTF-8 bytes, words are found and hashed with numpy, and no
Python object is made per word.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes are 64 bits
and equal in every process: they depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once; bounds the temporaries, not the texts.
CHUNK = 1 << 20
#: Text bytes in one numpy step of ``slices``.
STEP = 4 << 20

_P = 0x9E3779B97F4A7C15 | 1
_INV_P = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    plain = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    with np.errstate(over="ignore"):
        powers, inverse = np.full(CHUNK + 1, _P, U64), np.full(CHUNK + 1, _INV_P, U64)
        powers[0] = inverse[0] = 1
        powers, inverse = np.cumprod(powers, dtype=U64), np.cumprod(inverse, dtype=U64)
    return plain, lower, powers, inverse


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each span of bytes; spans' starts ascend, and so do their ends.

    ``fold`` takes A-Z as a-z.  A span may be longer than ``CHUNK``.
    """
    plain, lower, powers, inverse = _tables()
    table = lower if fold else plain
    out = np.zeros(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + CHUNK, "right"))
        if j <= i:  # one span beyond the chunk: add up its parts
            total, scale, at, stop = 0, 1, a, int(ends[i])
            while at < stop:
                part = data[at : min(at + CHUNK, stop)]
                total += scale * int((table[part] * powers[: len(part)]).sum(dtype=U64))
                scale = scale * int(powers[len(part)]) % (1 << 64)
                at += len(part)
            out[i] = total % (1 << 64)
            i += 1
            continue
        part = table[data[a : int(ends[j - 1])]]
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=sums[1:])
        lo, hi = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[hi] - sums[lo]) * inverse[lo]
        i = j
    return mix64(out + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


class Texts(NamedTuple):
    """Some texts as bytes: text k is ``data[offsets[k]:offsets[k + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, k: int) -> str:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().decode("utf-8", "replace")


def as_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """A string column as bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if not len(column):
        return Texts(data[:0], np.zeros(1, np.int64))
    return Texts(data[raw[0] : raw[-1]], raw - raw[0])


def slices(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes each, one row at least."""
    n = len(column)
    if not n:
        return
    sizes = np.diff(as_texts(column).offsets)
    total, first = 0, 0
    for k in range(n):
        if total and total + sizes[k] > step:
            yield first, k
            total, first = 0, k
        total += int(sizes[k])
    yield first, n


class Words(NamedTuple):
    """The words of some texts, in order.  Text k has words ``first[k]:first[k + 1]``."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, fold: bool = True) -> np.ndarray:
        return span_hashes(self.texts.data, self.starts, self.ends, fold)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(texts: Texts, within: np.ndarray | None = None) -> Words:
    """Where the words of each text are; or the runs of the bytes that ``within`` (256 flags) names."""
    data, offsets = texts
    inside = ~SPACE[data] if within is None else within[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte starts a word, its last ends one
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Words(texts, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def shingle_sets(words: Words, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed ``width``-word shingles of each text, ascending, and where each text's begin.

    A text of fewer words has its whole sequence as its only shingle; one
    without words has none.
    """
    h = words.hashes()
    n = len(h)
    whole = mix64(h + U64(1))
    rolled = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        rolled = mix64(rolled * U64(0x9FB21C651E98DF25) + h[k : k + len(rolled)])
    sets, sizes = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            s = np.unique(rolled[a : b - width + 1])
        elif b > a:
            x = whole[a]
            for k in range(a + 1, b):
                x = mix64((x * U64(0xD1342543DE82EF95) + h[k])[None])[0]
            s = np.array([x], U64)
        else:
            s = rolled[:0]
        sets.append(s)
        sizes.append(len(s))
    return np.concatenate(sets) if sets else rolled[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def char_counts(texts: Texts) -> np.ndarray:
    """Code points of each text."""
    lead = (texts.data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(lead)])
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]
