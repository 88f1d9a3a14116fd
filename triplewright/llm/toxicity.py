"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triplewright.llm.common import arrow_map, crc_fold, session, stored
from triplewright.llm.textops import U64, Texts, as_texts, find_words, mix64, slices, span_hashes

#: Labelled rows that the fit uses at most, by class; taken by a hash of the id where there are more.
MOST_TOXIC, MOST_CLEAN = 8_000, 20_000
#: Mined strings that are examined, that enter the classifier, and that vote.
MOST_STRINGS, FEATURES, VOTERS = 200_000, 4096, 384
PREFIXES = (4, 5, 6, 7, 8, 10)
LEVELS = (1, 2, 4)

LEXICON = """idiot idiots moron morons stupid dumb trash garbage loser losers scum pathetic disgusting worthless clown clowns
hate hates kill die filthy vermin ugly fool fools jerk bastard bitch crap damn shit fuck fucking asshole retard freak
imbecile dumbass scumbag lowlife degenerate parasite subhuman""".split()
SECOND = "you your youre ur u they them".split()
#: Statistics that vote by pattern: an insult, two, an insult after a second person, shouting, exclaiming.
PATTERNS = 5

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted ``known``; -1 if it isn't."""
    if not len(known) or not len(h):
        return np.full(len(h), -1, np.int64)
    maybe = np.zeros(1 << 20, bool)  # most are ruled out by one look
    maybe[(known >> U64(44)).astype(np.int64)] = True
    out = np.full(len(h), -1, np.int64)
    rows = np.flatnonzero(maybe[(h >> U64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, h[rows]), len(known) - 1)
    hit = known[at] == h[rows]
    out[rows[hit]] = at[hit]
    return out


def strings(texts: Texts, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed strings of each text - words of letters, and their beginnings - that ``known`` has, with levels.

    Returns owners, hashes, and the patterns of each text.  A string counts
    once for each level of ``LEVELS`` that its occurrences reach.
    """
    n, data = len(texts), texts.data
    words = find_words(texts, _LETTERS)
    owner = np.repeat(np.arange(n), words.counts())
    whole = words.hashes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, words.starts)
    owners, found = [], []

    def add(h: np.ndarray, own: np.ndarray) -> None:
        if known is not None:
            # any level of the string that is known
            keep = np.zeros(len(h), bool)
            for level in LEVELS:
                keep |= _among(mix64(h + U64(level)), known) >= 0
            h, own = h[keep], own[keep]
        found.append(h)
        owners.append(own)

    add(whole, owner)
    for k in PREFIXES:
        at = np.minimum(first + k, len(lead) - 1) if len(lead) else first
        end = lead[at] if len(lead) else words.ends
        long = (end < words.ends) & (first + k < len(lead))
        add(mix64(span_hashes(data, words.starts[long], end[long]) + U64(k * 0x1F3)), owner[long])
    own, h = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(h)))
    own, h = own[head], h[head]
    owners, found = [own], [mix64(h + U64(1))]
    for level in LEVELS[1:]:
        often = times >= level
        owners.append(own[often])
        found.append(mix64(h[often] + U64(level)))
    own, h = np.concatenate(owners), np.concatenate(found)
    if known is not None:
        keep = _among(h, known) >= 0
        own, h = own[keep], h[keep]
    # the patterns
    insult = _among(whole, _LEX) >= 0
    insults = np.bincount(owner[insult], minlength=n)
    second = np.flatnonzero(_among(whole, _SECOND) >= 0)
    aimed = np.zeros(n, bool)
    for step in range(1, 5):
        at = second[second + step < len(whole)]
        aimed[owner[at[insult[at + step] & (owner[at + step] == owner[at])]]] = True
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[texts.offsets])
    letters, upper, cries = total(_LETTERS[data]), total((data >= 65) & (data < 91)), total(data == 33)
    patterns = np.stack([insults > 0, insults > 1, aimed, (upper * 2 > letters) & (letters > 20), cries * 50 > np.maximum(words.counts(), 10)], 1)
    return own, h, patterns


_LEX, _SECOND = _hashes(LEXICON), _hashes(SECOND)


class Scorer(NamedTuple):
    """A linear classifier: sorted hashes with their weights, weights of patterns and of length, a constant."""

    hashes: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    length: float
    constant: float

    def score(self, texts: Texts) -> np.ndarray:
        own, h, patterns = strings(texts, self.hashes)
        gap = np.bincount(own, self.weights[_among(h, self.hashes)], len(texts)) + patterns @ self.patterns + self.constant + self.length * np.log1p(np.diff(texts.offsets) / 100)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 10, start: float = 0.9) -> np.ndarray:
    """The posterior that each row is toxic.

    ``votes`` (rows x voters) marks which voters say toxic; one that is silent
    speaks for clean by its own rate.  The given label is one more voter, whose
    rates are estimated like the others': ``start`` is what it is taken to be
    right before the first round, no more.  Expectation-maximisation estimates
    each voter's rate in either class.  Voters that fire together beyond what
    the class explains share their evidence: each counts as one over the sum
    of its positive correlations with the others, given the class.
    """
    n, m = votes.shape
    v = votes.astype(np.float32, copy=False)
    says = given > 0
    p = np.where(says, start, 1 - start).astype(float)
    for _ in range(rounds):
        on, off = p * weight, (1 - p) * weight
        right, wrong = ((x[says].sum() + 0.5) / (x.sum() + 1) for x in (on, off))
        label = np.where(says, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        a = (v.T @ on + 0.5) / (on.sum() + 1)
        b = (v.T @ off + 0.5) / (off.sum() + 1)
        cov = np.zeros((m, m))
        for k in range(0, n, 4096):
            e = slice(k, k + 4096)
            rest = v[e] - np.outer(p[e], a) - np.outer(1 - p[e], b)
            cov += (rest * weight[e, None]).T @ rest
        cov /= weight.sum()
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        share = 1 / np.maximum(np.clip(cov / np.outer(spread, spread), 0, 1).sum(1), 1)
        fire, quiet = np.log(a / b), np.log((1 - a) / (1 - b))
        prior = np.log((on.sum() + 1) / (off.sum() + 1))
        p = 1 / (1 + np.exp(-np.clip(prior + v @ ((fire - quiet) * share) + (quiet * share).sum() + label, -30, 30)))
    return p


def linear(owner: np.ndarray, column: np.ndarray, dense: np.ndarray, target: np.ndarray, weight: np.ndarray, columns: int, steps: int = 500, rate: float = 0.1, decay: float = 4e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse marks and dense columns, by Adam over all rows."""
    n, d = len(target), dense.shape[1]
    w = np.zeros(columns + d + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[column], n) + dense @ w[columns:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.concatenate([np.bincount(column, g[owner], columns), dense.T @ g, [g.sum()]])
        grad[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[:columns], w[columns:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Scorer:
    """Fit on the labelled rows outside fold 0, a hash sample of about ``most_toxic`` and ``most_clean`` where there are more."""
    spark = session(docs.sparkSession)
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (crc_fold(id_column) != 0)).select(F.col(id_column).alias("__id"), (F.col(label_column) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    shares = {1: min(1.0, most_toxic / max(1, sizes.get(1, 0))), 0: min(1.0, most_clean / max(1, sizes.get(0, 0)))}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("__id")), F.lit(1_000_000)) / 1e6
    chosen = known.where(draw < F.when(F.col("y") == 1, shares[1]).otherwise(shares[0]))
    few = sum(sizes.get(c, 0) * shares[c] for c in (0, 1)) <= 2 * (MOST_TOXIC + MOST_CLEAN)
    sample = stored(docs.select(id_column, text_column).join(F.broadcast(chosen) if few else chosen, F.col(id_column) == F.col("__id")).select("y", text_column))

    def counts(of: int, only: np.ndarray | None):
        def run(batches):
            held = []
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                column = batch.column(1).filter(pa.array(y == of))
                for a, b in slices(column):
                    held.append(strings(as_texts(column.slice(a, b - a)), only)[1])
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        return arrow_map(sample, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))

    n_toxic, n_clean = (max(1.0, sizes.get(c, 0) * shares[c]) for c in (1, 0))
    rows = counts(1, None).where(F.col("n") >= max(3, n_toxic / 2000)).orderBy(F.desc("n"), "h").limit(MOST_STRINGS).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    hashes, on = hashes[order], rows["n"].to_numpy(np.int64)[order].astype(float)
    off = np.zeros(len(hashes))
    if len(hashes):
        other = counts(0, hashes).toPandas()
        off[np.searchsorted(hashes, other["h"].to_numpy(np.int64).view(U64))] = other["n"].to_numpy(np.int64)
    lift = np.log((on + 0.5) / (n_toxic + 1)) - np.log((off + 0.5) / (n_clean + 1))
    worth = on / n_toxic * lift  # what knowing it is worth among the toxic
    top = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    top = top[lift[top] > 0.7]
    hashes, lift, on = hashes[top], lift[top], on[top]

    def marks(batches):
        for batch in batches:
            y, column = batch.column(0), batch.column(1)
            for a, b in slices(column):
                texts = as_texts(column.slice(a, b - a))
                own, h, patterns = strings(texts, hashes)
                at = _among(h, hashes).astype(np.int32)
                order = np.argsort(own, kind="stable")
                edges = np.searchsorted(own[order], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(at[order]))
                dense = np.concatenate([patterns, np.log1p(np.diff(texts.offsets) / 100)[:, None]], 1)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), PATTERNS + 1).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([y.slice(a, b - a), lists, flat], names=["y", "at", "dense"])

    table = arrow_map(sample, marks, "y int, at array<int>, dense array<double>").toPandas()
    if not len(table):
        return Scorer(hashes[:0], lift[:0], np.zeros(PATTERNS), 0.0, -3.0)
    y = table["y"].to_numpy()
    sizes_at = table["at"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(table)), sizes_at)
    column = np.concatenate([np.zeros(0, np.int64), *table["at"].tolist()]).astype(np.int64)
    dense = np.stack(table["dense"].tolist())
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    # voters: the strings that speak most clearly, and the patterns
    clear = np.argsort(-np.where(lift > 2, on * lift, -1), kind="stable")[:VOTERS]
    slot = np.full(len(hashes), -1)
    slot[clear] = np.arange(len(clear))
    votes = np.zeros((len(table), len(clear) + PATTERNS), np.float32)
    own_slot = slot[column] if len(column) else column
    votes[owner[own_slot >= 0], own_slot[own_slot >= 0]] = 1
    votes[:, len(clear) :] = dense[:, :PATTERNS]
    posterior = label_model(votes, y, weight)
    w, more, constant = linear(owner, column, dense, posterior, weight, len(hashes))
    return Scorer(hashes, w, more[:PATTERNS], float(more[PATTERNS]), constant)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Every whole text's toxicity: the id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Voters are strings mined from labelled rows (words, and beginnings of
    words, by how often they occur) and fixed patterns over an English insult
    lexicon.  A generative model estimates their rates and correlations and
    gives each sampled row a posterior label, on which a linear classifier is
    trained; all rows are scored by it in their partitions, without a shuffle.

    Labels are read from folds 1 to 4 alone (``held_out`` marks fold 0).  Null
    texts are empty and scored; repeated ids and label rows count each; null
    ids match no label; other columns don't matter.  Without labels every score
    is low; an empty table gives an empty result.
    """
    model = learn(docs, labels, id_column, text_column, label_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(as_texts(column.slice(a, b - a))))], names=[id_column, "score"])

    scored = arrow_map(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, score double")
    return scored.select(id_column, (crc_fold(id_column) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
