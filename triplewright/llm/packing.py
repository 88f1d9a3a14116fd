"""Packing documents into token windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from triplewright.llm import bpe
from triplewright.llm.common import arrow_map
from triplewright.llm.textops import as_texts, slices

#: Tokens packed together: bounds a task's memory (4 bytes a token), at a cost of one part-filled window for each.
GROUP_TOKENS = 2_000_000
#: Bytes of text encoded at once.
STEP = 1 << 19


class RoomTree:
    """The open windows by room left: a segment tree whose leaves are the amounts of room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and that room; None if there is none."""
        tree, k = self.tree, need + self.size
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k <<= 1
                if not tree[k]:
                    k += 1
        room = k - self.size
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece; no piece is longer than ``window``."""
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(window), 0
    order = np.argsort(-lengths, kind="stable")
    for k, need in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(need)
        if found is None:
            found, opened = (opened, window), opened + 1
        target, room = found
        where[k], at[k] = target, window - room
        if room > need:
            tree.put(room - need, target)
    return where, at


def top_up(doc: np.ndarray, start: np.ndarray, length: np.ndarray, where: np.ndarray, window: int):
    """Empty the least filled windows into the room of the others, cutting pieces to fit.

    The room left in a group is then less than one window.  Returns the pieces
    anew: document, start, length, window, offset.
    """
    used = np.bincount(where, weights=length).astype(np.int64)
    room = window - used
    by_fill = np.argsort(used, kind="stable")
    spare = np.cumsum(room[by_fill[::-1]])[::-1]  # room in this window and the fuller ones
    filled = np.cumsum(used[by_fill])
    # the first windows go while all of them fit into the room of the rest
    gone = int(np.searchsorted(-(np.append(spare[1:], 0) - filled), 1))
    n_gone = np.zeros(len(used), bool)
    n_gone[by_fill[:gone]] = True
    keep = ~n_gone[where]
    pieces = [(int(d), int(s), int(n), int(w)) for d, s, n, w in zip(doc[keep], start[keep], length[keep], where[keep])]
    holes = [[int(w), int(room[w])] for w in by_fill[gone:][::-1] if room[w]]
    holes.sort(key=lambda h: -h[1])
    k = 0
    moved = np.flatnonzero(~keep)
    for i in moved[np.argsort(-length[moved], kind="stable")].tolist():
        s, n = int(start[i]), int(length[i])
        while n:
            w, free = holes[k]
            part = min(n, free)
            pieces.append((int(doc[i]), s, part, w))
            s, n, holes[k][1] = s + part, n - part, free - part
            if not holes[k][1]:
                k += 1
    out = np.array(pieces, np.int64).reshape(-1, 4)
    out = out[np.lexsort((out[:, 1], out[:, 0], out[:, 3]))]
    _, names = np.unique(out[:, 3], return_inverse=True)
    total = np.cumsum(out[:, 2])
    heads = np.flatnonzero(np.diff(names, prepend=-1))
    base = (total - out[:, 2])[heads]
    return out[:, 0], out[:, 1], out[:, 2], names, total - out[:, 2] - base[names]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``window`` tokens.

    A document's tokens are its text's ids without added special tokens, then
    ``end_id``.  Documents longer than a window are first cut into full windows
    and a rest; rests and short documents are placed by best-fit decreasing,
    where a segment tree over the room left finds the tightest open window.
    Last, the least filled windows are emptied into the room of the others (see
    ``top_up``), so that less than one window of room is left for each
    ``GROUP_TOKENS``.  A sequence that doesn't end up full is padded by its reader.

    Each partition packs its own rows as they stream by: there is no shuffle,
    and a task holds ``GROUP_TOKENS`` tokens at most beside the document that
    crosses it.  Returns one row for each piece: the id, ``start``, ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` (unique in the result), ``offset``.

    A null or empty text is the one token ``end_id``.  Repeated rows and ids
    are documents each; null ids stay null; other columns don't matter; an
    empty table gives no sequences.
    """
    path = bpe.tokenizer_path(tokenizer)
    kind = docs.schema[id_column].dataType.simpleString()
    table = bpe.vocabulary_table(path)

    def flush(names, keys, held, base):
        sizes = np.array([len(x) for x in held], np.int64)
        cuts = -(-sizes // window)
        doc = np.repeat(np.arange(len(held)), cuts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
        length = np.minimum(window, sizes[doc] - start)
        full = length == window
        where, _ = best_fit(length[~full], window)
        n_full = int(full.sum())
        parts = [(doc[full], start[full], length[full], np.arange(n_full), np.zeros(n_full, np.int64))]
        if (~full).any():
            rest = top_up(doc[~full], start[~full], length[~full], where, window)
            parts.append((*rest[:3], rest[3] + n_full, rest[4]))
        doc, start, length, where, at = (np.concatenate(x) for x in zip(*parts))
        ids = pa.array([held[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())], pa.binary())
        own = pa.concat_arrays(keys).take(pa.array(doc))
        step = 20_000
        for k in range(0, len(doc), step):
            e = slice(k, k + step)
            yield pa.RecordBatch.from_arrays([own.slice(k, step), pa.array(start[e]), pa.array(length[e]), ids.slice(k, step), pa.array(sizes[doc[e]]), pa.array(where[e] + base), pa.array(at[e])], names=names)

    def run(batches):
        names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        keys, held, total = [], [], 0
        encoder = bpe.worker_encoder(path, table)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column, STEP):
                ids, at = encoder.encode(as_texts(column.slice(a, b - a)))
                first = 0
                for k in range(b - a):
                    held.append(np.concatenate([ids[at[k] : at[k + 1]], end]).astype("<u4", copy=False))
                    total += len(held[-1])
                    if total >= GROUP_TOKENS:
                        keys.append(batch.column(0).slice(a + first, k + 1 - first))
                        first = k + 1
                        yield from flush(names, keys, held, base)
                        base += total  # more than the windows that it made
                        keys, held, total = [], [], 0
                keys.append(batch.column(0).slice(a + first, b - a - first))
        if held:
            yield from flush(names, keys, held, base)

    schema = f"`{id_column}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return arrow_map(docs.select(id_column, text_column), run, schema)
