"""Masked pseudo-likelihood scores: a small window network, trained in numpy where the text lies.

Every word of a text is predicted from the two words on either side of it.
Output is factored: a class of 64 words, then the word within it, over the
corpus's most frequent words and 64 hashed buckets for the rest.  A word of
the rest has its own share of its bucket, by its count in the whole corpus.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from triplewright.llm.common import arrow_map, session, shuffle_partitions, stored
from triplewright.llm.textops import U64, as_texts, find_words, mix64, slices

CLASSES, PER_CLASS = 64, 64
WORDS = CLASSES * PER_CLASS
#: Words with an entry of their own; the last class holds the hashed rest.
NAMED = WORDS - PER_CLASS
REACH, EMBED, HIDDEN = 2, 16, 48
CONTEXT = 2 * REACH
#: Words predicted in one step of training, and in one step of scoring.
MINIBATCH, SCORE_BATCH = 1024, 8192
#: After so many steps of a task, steps are of four minibatches: half the time a word.
SMALL_STEPS, LARGE_STEP = 64, 4
#: Logits up to this size either way need no scaling before their exponential.
SAFE = 60.0
CHUNK = 16_384
#: Occurrences that every word of the rest, and one that wasn't counted, has besides its own.
SMOOTH = 0.1
#: Counted words in a part of the rest, about, and parts at least.
PART_WORDS, LEAST_PARTS = 2_000_000, 12
#: Counts that are handed on together.
COUNTS = 200_000


class Vocabulary(NamedTuple):
    """Hashes of the named words (sorted), the word number of each, all words' log-shares, and a table that finds a hash's place by its low bits."""

    hashes: np.ndarray
    numbers: np.ndarray
    log_share: np.ndarray
    table: np.ndarray | None = None

    @classmethod
    def of(cls, hashes: np.ndarray, numbers: np.ndarray, log_share: np.ndarray) -> Vocabulary:
        """With the smallest table in which each hash has one of two places, by its low or its high bits."""
        for bits in range(14, 24):
            table, placed = np.full(1 << bits, -1, np.int16), np.zeros(len(hashes), bool)
            for where in (hashes & U64((1 << bits) - 1), hashes >> U64(64 - bits)):
                where = where.astype(np.int64)
                todo = np.flatnonzero(~placed)
                todo = todo[table[where[todo]] < 0]
                table[where[todo]] = todo
                placed[todo] = table[where[todo]] == todo
            if placed.all():
                return cls(hashes, numbers, log_share, table)
        return cls(hashes, numbers, log_share)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        out = NAMED + (h & U64(PER_CLASS - 1)).astype(np.uint16)
        if not len(self.hashes):
            return out
        if self.table is None:
            tries = [(slice(None), np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1))]
        else:
            bits = len(self.table).bit_length() - 1
            at = self.table[(h & U64(len(self.table) - 1)).astype(np.int64)]
            rest = np.flatnonzero(self.hashes[at] != h)
            tries = [(slice(None), at), (rest, self.table[(h[rest] >> U64(64 - bits)).astype(np.int64)])]
        for where, at in tries:  # a place of -1 is the last hash's, which is compared like the others
            hit = self.hashes[at] == h[where]
            out[where] = np.where(hit, self.numbers[at], out[where])
        return out


def count_words(docs: DataFrame, text_column: str) -> DataFrame:
    """Occurrences of every word of all texts: (``h``, ``n``), added up in each task before the shuffle."""

    def run(batches):
        h0, n0, recent, size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

        def fold():
            h, n = np.unique(np.concatenate(recent), return_counts=True)
            h, n = np.concatenate([h0, h]), np.concatenate([n0, n])
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, n, len(u)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(h0.view(np.int64)), pa.array(n0)], names=["h", "n"])

        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column):
                recent.append(find_words(as_texts(column.slice(a, b - a))).hashes())
                size += len(recent[-1])
                if size > 2_000_000:
                    h0, n0 = fold()
                    recent, size = [], 0
                    if len(h0) > 2_000_000:  # hand on what a task can't hold
                        yield out()
                        h0, n0 = h0[:0], n0[:0]
        if recent:
            h0, n0 = fold()
        if len(h0):
            yield out()

    return arrow_map(docs.select(text_column), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Rest(NamedTuple):
    """All words' counts, as a table; and by bucket, occurrences and words of the rest."""

    counted: DataFrame
    n: np.ndarray
    words: np.ndarray


def vocabulary(docs: DataFrame, text_column: str) -> tuple[Vocabulary, Rest]:
    """The corpus's ``NAMED`` most frequent words, in order of frequency, and how often all others occur by bucket."""
    counted = stored(count_words(docs, text_column))
    top = counted.orderBy(F.desc("n"), "h").limit(NAMED).toPandas()
    rest = counted.groupBy((F.col("h").bitwiseAND(F.lit(PER_CLASS - 1))).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(U64), top["n"].to_numpy(np.int64)
    share = np.zeros(WORDS)
    share[: len(n)] = n
    share[NAMED + rest["bucket"].to_numpy(np.int64)] = rest["n"].to_numpy(np.int64)
    np.subtract.at(share, NAMED + (h & U64(PER_CLASS - 1)).astype(np.int64), n)
    words = np.zeros(PER_CLASS, np.int64)
    words[rest["bucket"].to_numpy(np.int64)] = rest["words"].to_numpy(np.int64)
    np.subtract.at(words, (h & U64(PER_CLASS - 1)).astype(np.int64), 1)
    left = share[NAMED:].copy()
    order = np.argsort(h)
    share = np.maximum(share, 0) + 0.1
    return Vocabulary.of(h[order], np.arange(len(h))[order], np.log(share / share.sum()).astype(np.float32)), Rest(counted, left, words)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) % U64(parts)).astype(np.int64)


def rest_shares(asked: DataFrame, rest: Rest, parts: int) -> DataFrame:
    """(``row``, ``log_rest``): for each row, the log-shares of its rest words within their buckets, added up.

    ``asked``: blobs of (``part``, ``row``, ``h``, ``who``, ``word``): the words
    of a part of the hashes that some rows hold, and for each occurrence the
    row, counted from ``row``, and the word's place in ``h``.
    """
    log_total = np.log(rest.n + SMOOTH * (rest.words + 1))

    def blobs(batches):
        held, size = [], 0

        def out():
            h, n = (np.concatenate(x) for x in zip(*held))
            part = _part(h.view(U64), parts)
            rows = [(p, h[part == p].tobytes(), n[part == p].tobytes()) for p in np.unique(part).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "h", "who"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= COUNTS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def run(batches):
        part, counts, table = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                p, row, h, who, word = (batch.column(c)[k] for c in range(5))
                if p.as_py() != part:
                    part, counts, table = p.as_py(), [], None
                h = np.frombuffer(h.as_buffer(), U64)
                if not row.is_valid:  # counts come before the words asked for
                    counts.append((h, np.frombuffer(who.as_buffer(), np.int64)))
                    continue
                if table is None:
                    known, n = (np.concatenate(x) for x in zip(*counts)) if counts else (np.zeros(1, U64), np.zeros(1, np.int64))
                    by = np.argsort(known)
                    table, counts = (known[by], n[by]), []
                at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                n = np.where(table[0][at] == h, table[1][at], 0)
                logs = np.log(n + SMOOTH) - log_total[(h & U64(PER_CLASS - 1)).astype(np.int64)]
                who = np.frombuffer(who.as_buffer(), np.int32)
                sums = np.bincount(who, logs[np.frombuffer(word.as_buffer(), np.int32)])
                own = np.unique(who)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64) + row.as_py()), pa.array(sums[own])], names=["row", "log_rest"])

    counts = arrow_map(rest.counted, blobs, "part long, h binary, who binary").select("part", F.lit(None).cast("long").alias("row"), "h", "who", F.lit(None).cast("binary").alias("word"))
    both = counts.unionByName(asked).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.asc_nulls_first("row"))
    return arrow_map(both, run, "row long, log_rest double").groupBy("row").agg(F.sum("log_rest").alias("log_rest"))


def _shapes() -> list[tuple[str, tuple[int, ...]]]:
    return [("embed", (WORDS + 1, EMBED)), ("w1", (CONTEXT * EMBED, HIDDEN)), ("b1", (HIDDEN,)), ("wc", (HIDDEN, CLASSES)), ("bc", (CLASSES,)), ("wo", (CLASSES, HIDDEN, PER_CLASS)), ("bo", (CLASSES, PER_CLASS))]


def _exponentials(z: np.ndarray, at: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into exponentials; returns each row's log-share of its place ``at`` in the flat array, and its sum."""
    if not (z.max(initial=0) <= SAFE and z.min(initial=0) >= -SAFE):
        z -= z.max(1, keepdims=True)
    logs = z.ravel()[at]
    np.exp(z, out=z)
    s = z @ ones
    logs -= np.log(s)
    return logs, s


class Network:
    """The weights, one flat array; word ``WORDS`` stands for a text's edge."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in _shapes():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for _, s in _shapes())

    @classmethod
    def fresh(cls, words: Vocabulary, seed: int) -> Network:
        """Small random weights; output biases say each word's share, so training starts from the unigram model."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.size(), np.float32))
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.w1[:] = rng.normal(0, 1 / np.sqrt(CONTEXT * EMBED), net.w1.shape)
        net.wc[:] = rng.normal(0, 0.01, net.wc.shape)
        net.wo[:] = rng.normal(0, 0.01, net.wo.shape)
        share = words.log_share.reshape(CLASSES, PER_CLASS)
        total = np.log(np.exp(share).sum(1))
        net.bc[:], net.bo[:] = total, share - total[:, None]
        return net

    def forward(self, context: np.ndarray, word: np.ndarray, back: Network | None = None) -> np.ndarray:
        """Log-probability of each word given its context; adds to the gradients of ``back``."""
        n = len(word)
        order = np.argsort((word // PER_CLASS).astype(np.uint8), kind="stable")  # a class's words are neighbours
        context, word = context[order], word[order]
        kind, within, rows = word // PER_CLASS, word % PER_CLASS, np.arange(n)
        edge = np.searchsorted(kind, np.arange(CLASSES + 1))
        x = self.embed.take(context, 0).reshape(n, CONTEXT * EMBED)
        one = np.ones((n, HIDDEN + 1), self.flat.dtype)  # the hidden values, and a last one for the biases
        h = one[:, :HIDDEN]
        np.matmul(x, self.w1, out=h)
        h += self.b1
        np.tanh(h, out=h)
        ones = np.ones(PER_CLASS, self.flat.dtype)
        z = one @ np.concatenate([self.wc, self.bc[None]])
        logs, s = _exponentials(z, rows * CLASSES + kind, ones[:CLASSES])
        weights = np.concatenate([self.wo, self.bo[:, None]], 1)
        v = np.empty((n, PER_CLASS), self.flat.dtype)
        classes = [(c, slice(edge[c], edge[c + 1])) for c in np.flatnonzero(np.diff(edge)).tolist()]
        for c, own in classes:
            np.matmul(one[own], weights[c], out=v[own])
        at = rows * PER_CLASS + within
        more, sv = _exponentials(v, at, ones)
        logs += more
        if back is not None:
            z /= s[:, None]
            z.ravel()[rows * CLASSES + kind] -= 1
            grad = one.T @ z
            back.wc += grad[:HIDDEN]
            back.bc += grad[HIDDEN]
            v /= sv[:, None]
            v.ravel()[at] -= 1
            dh = np.empty((n, HIDDEN), self.flat.dtype)
            for c, own in classes:
                grad = one[own].T @ v[own]
                back.wo[c] += grad[:HIDDEN]
                back.bo[c] += grad[HIDDEN]
                np.matmul(v[own], self.wo[c].T, out=dh[own])
            dh += z @ self.wc.T
            np.multiply(h, h, out=h)
            np.subtract(1, h, out=h)
            dh *= h
            back.w1 += x.T @ dh
            back.b1 += np.ones(n, self.flat.dtype) @ dh
            dx = (self.w1 @ dh.T).reshape(CONTEXT, EMBED, n)
            flat = context.T.astype(np.int64).ravel()
            for k in range(EMBED):
                back.embed[:, k] += np.bincount(flat, dx[:, k].ravel(), WORDS + 1)
        out = np.empty_like(logs)
        out[order] = logs
        return out


def windows(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words around each word of its text; beyond the text's edges, ``WORDS``."""
    n, out = len(numbers), np.full((len(numbers), CONTEXT), WORDS, np.uint16)
    begin, end = first[:-1], first[1:]
    for k in range(1, REACH + 1):
        before, after = out[:, REACH - k], out[:, REACH + k - 1]
        before[k:], after[: n - k] = numbers[: max(0, n - k)], numbers[k:]
        for j in range(k):  # the text's first words have none so far before, its last ones none so far after
            edge = begin + j
            before[edge[edge < end]] = WORDS
            edge = end - 1 - j
            after[edge[edge >= begin]] = WORDS
    return out


def train(docs: DataFrame, words: Vocabulary, text_column: str, stride: int, rate: float, seed: int, rounds: int = 2) -> Network:
    """In each round every task trains a copy on its own texts of that round; the next round starts from their mean by words seen.

    Texts are dealt to the ``rounds`` by a hash, so that every word of every
    text is a target once, or with a ``stride`` about one word in so many, by a
    hash of text and place.  The more tasks there are, the fewer words each
    copy sees before the mean, and the nearer the mean stays to the round's
    start; more rounds make up for that, at one more scan each.  Copies are
    added up in two shuffles of 64 kB pieces; only the mean, about 1 MB,
    reaches the driver.
    """
    net = Network.fresh(words, seed)
    for k in range(rounds):
        own = docs.where(F.pmod(F.xxhash64(F.lit(seed), F.col(text_column)), F.lit(rounds)) == k) if rounds > 1 else docs
        net = _trained(own, words, net, text_column, stride, rate)
    return net


def _trained(docs: DataFrame, words: Vocabulary, start: Network, text_column: str, stride: int, rate: float) -> Network:
    """The mean of the tasks' copies after one round."""
    sent = docs.sparkSession.sparkContext.broadcast((words, start.flat))

    def run(batches):
        words, flat = sent.value
        net = Network(flat.copy())
        m, s, t = np.zeros_like(net.flat), np.zeros_like(net.flat), np.zeros_like(net.flat)
        contexts, targets, held, seen, step = [], [], 0, 0, 0

        def learn(context, word):
            nonlocal step
            step += 1
            grad = Network(np.zeros_like(net.flat))
            net.forward(context, word, grad)
            g = grad.flat
            g /= len(word)
            np.multiply(m, 0.9, out=m)
            np.multiply(g, 0.1, out=t)
            np.add(m, t, out=m)
            np.multiply(s, 0.999, out=s)
            g *= g
            g *= 0.001
            np.add(s, g, out=s)
            now = rate / np.sqrt(1 + step / 100)
            np.divide(s, 1 - 0.999**step, out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= now / (1 - 0.9**step)
            net.flat -= g

        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column):
                found = find_words(as_texts(column.slice(a, b - a)))
                hashes = found.hashes()
                numbers = words.look_up(hashes)
                if stride > 1:
                    chosen = np.arange(len(numbers))
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes, dtype=U64)])
                    text = np.repeat(sums[found.first[1:]] - sums[found.first[:-1]], found.counts())
                    place = (chosen - np.repeat(found.first[:-1], found.counts())).astype(U64)
                    chosen = np.flatnonzero(mix64(text + place) % U64(stride) == 0)
                context = windows(numbers, found.first)
                contexts.append(context if stride == 1 else context[chosen])
                targets.append(numbers if stride == 1 else numbers[chosen])
                held += len(targets[-1])
                if held >= MINIBATCH:
                    context, word = np.concatenate(contexts), np.concatenate(targets)
                    mixed, k = np.random.default_rng(step).permutation(len(word)), 0
                    while len(word) - k >= MINIBATCH:
                        size = LARGE_STEP * MINIBATCH if step >= SMALL_STEPS and len(word) - k >= LARGE_STEP * MINIBATCH else MINIBATCH
                        learn(context[mixed[k : k + size]], word[mixed[k : k + size]])
                        k += size
                    seen += k
                    left = mixed[k:]
                    contexts, targets, held = [context[left]], [word[left]], len(left)
        if held:
            learn(np.concatenate(contexts), np.concatenate(targets))
            seen += held
        if seen:
            task = TaskContext.get()
            salt = (task.partitionId() if task else 0) % 64
            parts = [net.flat[k : k + CHUNK] for k in range(0, len(net.flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "salt", "seen", "data"])

    def mean(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for part, salt, seen, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = sums.setdefault((part, salt), [0, 0.0])
                own[0] += seen
                own[1] = own[1] + np.frombuffer(data, np.float32).astype(np.float64) * seen
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["part", "salt", "seen", "data"])

    fields = "part int, salt int, seen long, data binary"
    n = min(32, shuffle_partitions(docs.sparkSession))
    copies = arrow_map(docs.select(text_column), run, fields)
    once = arrow_map(copies.repartition(n, "part", "salt"), mean, fields)
    rows = arrow_map(once.repartition(n, "part"), mean, fields).collect()
    if not rows:
        return start
    return Network(np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(rows, key=lambda r: r["part"])]).copy())


def score(docs: DataFrame, stride: int = 1, rate: float = 0.01, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pseudo-log-likelihood of every whole text: the id, ``n_words``, ``log_prob`` (summed), ``mean_log_prob``.

    Words are runs between spaces, A-Z as a-z.  Word counts are taken over all
    documents, training uses every word of all of them (one in ``stride``, if
    that is given), and every word of every text is scored.  The network depends
    on how the input is split into tasks (see ``train``); results are equal for
    equal splits.

    Null texts are empty; a text without words has no log-probability to add up
    (0.0) and a null mean.  Repeated rows are scored each, null ids stay null,
    other columns don't matter; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    words, rest = vocabulary(docs, text_column)
    parts = int(max(LEAST_PARTS, -(-rest.words.sum() // PART_WORDS)))
    net = train(docs, words, text_column, stride, rate, seed)
    sent = spark.sparkContext.broadcast((words, net.flat))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        words, flat = sent.value
        net = Network(flat)
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column):
                found = find_words(as_texts(column.slice(a, b - a)))
                hashes = found.hashes()
                numbers = words.look_up(hashes)
                context = windows(numbers, found.first)
                logs = np.zeros(len(numbers) + 1)
                for k in range(0, len(numbers), SCORE_BATCH):
                    e = slice(k, min(k + SCORE_BATCH, len(numbers)))
                    logs[e] = net.forward(context[e], numbers[e])
                total = np.concatenate([[0], np.cumsum(logs)])
                n = found.counts()
                sums = np.where(n > 0, total[found.first[1:]] - total[found.first[:-1]], 0.0)
                none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums), *none], names=names)
                other = np.flatnonzero(numbers >= NAMED)
                h, who = hashes[other], np.repeat(np.arange(len(n), dtype=np.int32), n)[other]
                part = _part(h, parts)
                by = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    own = by[edge[p] : edge[p + 1]]
                    u, back = np.unique(h[own], return_inverse=True)
                    blob = [pa.array([x], pa.binary()) for x in (u.tobytes(), who[own].tobytes(), back.astype(np.int32).tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([p]), *blob], names=names)
                row += len(n)

    names = ["row", "id", "n_words", "log_prob", "part", "h", "who", "word"]
    passed = stored(arrow_map(docs.select(id_column, text_column), run, f"row long, id {kind}, n_words long, log_prob double, part long, h binary, who binary, word binary"))
    shares = rest_shares(passed.where("part is not null").select("part", "row", "h", "who", "word"), rest, parts)
    log_prob = F.col("log_prob") + F.coalesce("log_rest", F.lit(0.0))
    out = passed.where("part is null").select("row", "id", "n_words", "log_prob").join(shares, "row", "left")
    return out.select(F.col("id").alias(id_column), "n_words", log_prob.alias("log_prob"), F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).alias("mean_log_prob"))
