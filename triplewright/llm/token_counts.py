"""Token counts in place: a broadcast table of the corpus's frequent pre-tokens, worker caches, then the merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triplewright.llm import bpe
from triplewright.llm.common import arrow_map
from triplewright.llm.textops import U64, Texts, as_texts, slices, span_hashes

#: Pre-tokens of the broadcast table (each some 30 bytes), and those that one task reports of its own.
FREQUENT, TASK_FREQUENT = 32_768, 4_096

_LIBRARY: dict = {}


def frequent_pieces(docs: DataFrame, path: str, text_column: str) -> list[bytes]:
    """The corpus's most frequent pre-tokens, the most frequent first.

    Every text's pre-tokens are counted where the text lies.  What leaves a
    task is its ``TASK_FREQUENT`` most frequent ones, so the choice may miss
    one that is rare in each task; that costs time, never a count.
    """

    def top(h, n, most):
        return np.sort(np.lexsort((h, -n))[:most])

    def run(batches):
        encoder = bpe.worker_encoder(path)
        h0, n0, pieces = np.zeros(0, U64), np.zeros(0, np.int64), {}
        for batch in batches:
            for a, b in slices(batch.column(0)):
                texts = as_texts(batch.column(0).slice(a, b - a))
                if not len(texts.data):
                    continue
                starts, _ = encoder._cuts(Texts(texts.data, texts.offsets))
                ends = np.append(starts[1:], len(texts.data))
                u, where, n = np.unique(span_hashes(texts.data, starts, ends, fold=False), return_index=True, return_counts=True)
                own = top(u, n, 4 * TASK_FREQUENT)
                raw = texts.data.tobytes()
                for k, i, j in zip(u[own].tolist(), starts[where[own]].tolist(), ends[where[own]].tolist()):
                    if k not in pieces:
                        pieces[k] = raw[i:j]
                h, back = np.unique(np.concatenate([h0, u[own]]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n0, n[own]]), len(h)).astype(np.int64)
                if len(h) > 16 * TASK_FREQUENT:
                    keep = top(h, n, 8 * TASK_FREQUENT)
                    h, n = h[keep], n[keep]
                    pieces = {k: pieces[k] for k in h.tolist()}
                h0, n0 = h, n
        keep = top(h0, n0, TASK_FREQUENT)
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array([pieces[k] for k in h0[keep].tolist()], pa.binary()), pa.array(n0[keep])], names=["piece", "n"])

    found = arrow_map(docs.select(text_column), run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r["piece"]) for r in found.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]


def _library_counts(path: str, texts: list[str]) -> list[int]:
    if path not in _LIBRARY:
        if path.endswith(".model"):
            import sentencepiece

            _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LIBRARY[path] = Tokenizer.from_file(path)
    tokenizer = _LIBRARY[path]
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The size of every whole text in bytes and tokens.

    Returns ``id_column``, ``n_bytes``, ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``), one row for each input row, in its partition: there
    is no shuffle of texts or pre-tokens.  ``tokenizer`` is the name of a
    public tokenizer or a path.  For a byte-level BPE file a first pass counts
    pre-tokens in their tasks; the ``FREQUENT`` most frequent ones are encoded
    on the driver and sent to all tasks with their lengths (about 1 MB), and
    what that table misses is encoded once per worker.  Pre-tokens are told
    apart by 64-bit hashes.  Other files are given to their library whole.

    A null or empty text has no bytes and no tokens.  A null id stays null;
    repeated rows and ids are counted each; other columns don't matter; an
    empty table gives an empty result.  No text is cut, however long.
    """
    path = bpe.tokenizer_path(tokenizer)
    sent = None
    if path.endswith(".json"):
        try:
            bpe.Encoder(path)
        except ValueError:  # no plain byte-level BPE
            pass
        else:
            sent = docs.sparkSession.sparkContext.broadcast(bpe.frequent_of(path, frequent_pieces(docs, path, text_column)))

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(column):
                texts = as_texts(column.slice(a, b - a))
                if sent is not None:
                    n = bpe.worker_encoder(path, sent.value).count(texts)
                else:
                    n = np.array(_library_counts(path, [texts.text(k) for k in range(len(texts))]), np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(n > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_map(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
