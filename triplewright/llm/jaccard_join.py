"""An exact n-gram Jaccard join with skipping by set relations.

Equal sets are one class from the start.  The shingles of a set are put in one
global order, rarest first, so that two sets of the wanted similarity share a
shingle among the first ones of each (the prefix).  Index lists hold only
prefixes; a list is sorted by set size and read in blocks, and what lies beyond
a set's size bound, or can't be reached from its position in the two sets any
more, or differs in too many bits of two small maps of the sets, is skipped.  A pair that several lists would give is left to one of them.

Candidate pairs are checked list by list: where sets are highly similar, one
set's intersections follow from those already known of another - only the few
shingles in which both differ from it are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triplewright.llm.common import arrow_map, discard, session, shuffle_partitions, stored
from triplewright.llm.components import components
from triplewright.llm.textops import U64, as_texts, find_words, mix64, shingle_sets, slices

#: Shingles whose frequency is known to the order: what every task is sent is 16 bytes for each.  The order decides what is fast, not what is found.
ORDERED_SHINGLES = 1 << 20
#: Frequent shingles that one task reports.
TASK_SHINGLES = 100_000
#: Postings that a bucket of lists holds, about: what bounds a task's memory.
BUCKET_POSTINGS = 4_000_000
#: Leading shingles that decide which list gives a pair.
LEADERS = 3
#: Bits of a set's parity map, from which a bound on any two sets' difference follows.
MAP_BITS = 512
#: Buckets at least, so that a small input has some tasks.
LEAST_BUCKETS = 12
#: Parts in which a task reads its bucket's lists, one after the other.
PARTS = 8
#: Rows of a list that are checked together.
BLOCK = 512
#: Classes up to this number are sent to the scan that rereads their texts; more are joined to it.
BROADCAST_CLASSES = 2_000_000
SETS_BYTES = 48 << 20


def _need(total: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets of this total size: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def _prefix(n: np.ndarray | int, percent: int):
    """A set of n shares this many first shingles at most before it is too dissimilar to all."""
    return n - -(-percent * n // 100) + 1


def _sets(column: pa.Array, width: int):
    """(first row, sets, edges) of each slice of a column."""
    for a, b in slices(column):
        yield a, *shingle_sets(find_words(as_texts(column.slice(a, b - a))), width)


def _signature(s: np.ndarray) -> int:
    return int(mix64(np.array([mix64(s * U64(0x9E3779B97F4A7C15) + U64(7)).sum(dtype=U64) + U64(len(s))]))[0].view(np.int64)) if len(s) else 0


def parity_map(s: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """For each of ``bits`` bits whether an odd number of the set's hashes fall on it.

    Where two maps differ the sets differ in a hash at least, so the differing
    bits are no more than the sets' symmetric difference.
    """
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(U64)


def full_map(s: np.ndarray) -> np.ndarray:
    """A parity map of one to two bits for each hash: enough to tell most pairs below the wanted similarity."""
    return parity_map(s, max(64, 1 << int(len(s) - 1).bit_length()))


def maps_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two parity maps differ, the larger folded to the smaller's size."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = folded(a)
    return int(np.bitwise_count(a ^ b).sum())


def folded(m: np.ndarray) -> np.ndarray:
    """A map of half the size: the halves' parities added."""
    half = len(m) // 2
    return m[:half] ^ m[half:]


def signatures(docs: DataFrame, id_column: str, text_column: str, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """One pass: a table of (``id``, ``n``, ``sig``, ``map``) by document; and frequent shingles, with how often they occur."""

    def run(batches):
        kept_h, kept_n = np.zeros(0, U64), np.zeros(0, np.int64)
        recent, size = [], 0

        def fold(h0, n0, parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            h, n = np.concatenate([h0, h]), np.concatenate([n0, n])
            u, back = np.unique(h, return_inverse=True)
            n = np.bincount(back, n, len(u)).astype(np.int64)
            often = n > 1
            u, n = u[often], n[often]
            if len(u) > 4 * TASK_SHINGLES:
                top = np.sort(np.argpartition(-n, 4 * TASK_SHINGLES)[: 4 * TASK_SHINGLES])
                u, n = u[top], n[top]
            return u, n

        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, sets, edges in _sets(column, width):
                k = len(edges) - 1
                sig = np.array([_signature(sets[edges[i] : edges[i + 1]]) for i in range(k)], np.int64)
                none = pa.nulls(k, pa.int64())
                maps = pa.array([full_map(sets[i:j]).tobytes() if j > i else None for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, k), pa.array(np.diff(edges)), pa.array(sig), none, maps], names=["id", "n", "sig", "times", "map"])
                recent.append(sets)
                size += len(sets)
                if size > 1_000_000:
                    kept_h, kept_n = fold(kept_h, kept_n, recent)
                    recent, size = [], 0
        if recent:
            kept_h, kept_n = fold(kept_h, kept_n, recent)
        if len(kept_h) > TASK_SHINGLES:
            top = np.argpartition(-kept_n, TASK_SHINGLES)[:TASK_SHINGLES]
            kept_h, kept_n = kept_h[top], kept_n[top]
        if len(kept_h):
            none = pa.nulls(len(kept_h), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(kept_h.view(np.int64)), pa.array(kept_n), pa.nulls(len(kept_h), pa.binary())], names=["id", "n", "sig", "times", "map"])

    table = stored(arrow_map(docs.select(F.col(id_column).cast("long"), text_column), run, "id long, n long, sig long, times long, map binary"))
    often = table.where("times is not null").groupBy("sig").agg(F.sum("times").alias("times")).where("times > 2").orderBy(F.desc("times"), "sig").limit(ORDERED_SHINGLES).toPandas()
    h, n = often["sig"].to_numpy(np.int64).view(U64), often["times"].to_numpy(np.int64)
    order = np.argsort(h)
    return table.where("times is null").select("id", "n", "sig", "map"), h[order], n[order]


def _ranked(s: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A set in the global order: by frequency, then by hash."""
    if not len(known):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return s[np.argsort(np.where(known[at] == s, times[at], 0), kind="stable")]


def _postings(docs: DataFrame, id_column: str, text_column: str, width: int, percent: int, order, buckets: int) -> DataFrame:
    """The prefixes as blobs: for each batch and bucket of shingles, the sets that have some there, and the postings."""

    def run(batches):
        known, times = order.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets, edges in _sets(batch.column(1), width):
                keys, sigs, sizes, leads, maps, counts = [], [], [], [], [], []
                for i in range(len(edges) - 1):
                    s = sets[edges[i] : edges[i + 1]]
                    if not len(s):
                        continue
                    sig = _signature(s)
                    if sig in seen:  # copies within the task
                        continue
                    seen.add(sig)
                    prefix = _ranked(s, known, times)[: _prefix(len(s), percent)]
                    lead = np.zeros(LEADERS, U64)
                    lead[: min(LEADERS, len(prefix))] = prefix[:LEADERS]
                    keys.append(prefix)
                    sigs.append(sig)
                    sizes.append(len(s))
                    leads.append(lead)
                    maps.append(parity_map(s))
                    counts.append(len(prefix))
                if len(seen) > 1_000_000:
                    seen.clear()
                if not keys:
                    continue
                key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), counts)
                place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
                bucket = ((key >> U64(32)) % U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
                sig_a, size_a, lead_a = np.array(sigs, np.int64), np.array(sizes, np.int32), np.concatenate([np.array(leads), np.array(maps)], 1)
                rows = []
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    own = by[edge[b] : edge[b + 1]]
                    who, local = np.unique(owner[own], return_inverse=True)
                    rows.append((b, sig_a[who].tobytes(), size_a[who].tobytes(), lead_a[who].tobytes(), key[own].tobytes(), local.astype(np.int32).tobytes(), np.minimum(place[own], 65535).astype(np.uint16).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows))], names=["bucket", "sig", "n", "lead", "key", "who", "place"])

    return arrow_map(docs.select(id_column, text_column), run, "bucket long, sig binary, n binary, lead binary, key binary, who binary, place binary")


def list_pairs(key: np.ndarray, who: np.ndarray, place: np.ndarray, size: np.ndarray, lead: np.ndarray, maps: np.ndarray, percent: int):
    """Candidate pairs of sets from index lists: yields (list block, first, second) arrays.

    ``key``, ``who``, ``place``: postings; ``size``, ``lead``, ``maps``: by set.
    """
    by = np.lexsort((who, size[who], key))
    key, who, place = key[by], who[by], place[by]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who, place = key[keep], who[keep], place[keep]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(key)))
    stop = np.repeat((start + length).astype(np.int32), length)
    rank = np.arange(len(key), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    n = size[who]
    live = np.flatnonzero(np.arange(len(key)) + 1 < stop)
    step = 1
    while len(live):
        # lists are sorted by size: from the first set that is too large on, a list is skipped
        live = live[live + step < stop[live]]
        live = live[100 * n[live].astype(np.int64) >= percent * n[live + step].astype(np.int64)]
        for part in range(0, len(live), 1 << 20):
            i = live[part : part + (1 << 20)]
            j = i + step
            ni, nj = n[i].astype(np.int64), n[j].astype(np.int64)
            need = _need(ni + nj, percent)
            reach = 1 + np.minimum(ni - 1 - place[i], nj - 1 - place[j])  # what the rest of both can add
            ok = reach >= need
            i, j, most = i[ok], j[ok], (ni + nj - 2 * need)[ok]
            apart = np.bitwise_count(maps[who[i]] ^ maps[who[j]]).sum(1, dtype=np.int64)
            ok = apart <= most
            i, j = i[ok], j[ok]
            # the first common leader in the global order is the sets' first common shingle, the only one at which reach bounds what they share
            leads = lead[who[i]]
            shared = ((leads[:, :, None] == lead[who[j]][:, None, :]) & (leads != 0)[:, :, None]).any(2)
            mine = ~shared.any(1) | (leads[np.arange(len(i)), shared.argmax(1)] == key[i])
            i, j = i[mine], j[mine]
            if len(i):
                block = mix64(key[i] + U64(0x9E37) * (rank[i] // BLOCK).astype(U64) + U64(0x79B9) * (rank[j] // BLOCK).astype(U64) * U64(65537))
                yield block, who[i], who[j]
        step += 1


def _candidates(postings: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Candidate pairs; each bucket is a task's own, and a task that is given several holds one at a time."""

    def by_bucket(batches):
        bucket, rows = None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for r in range(batch.num_rows):
                if columns[0][r].as_py() != bucket:
                    if rows:
                        yield rows
                    bucket, rows = columns[0][r].as_py(), []
                rows.append([np.frombuffer(columns[k][r].as_buffer(), t) for k, t in ((1, np.int64), (2, np.int32), (3, U64), (4, U64), (5, np.int32), (6, np.uint16))])
        if rows:
            yield rows

    def run(batches):
        for rows in by_bucket(batches):
            shift = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
            sig, back = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            size, lead = np.zeros(len(sig), np.int32), np.zeros((len(sig), LEADERS + MAP_BITS // 64), U64)
            size[back] = np.concatenate([r[1] for r in rows])
            lead[back] = np.concatenate([r[2].reshape(-1, LEADERS + MAP_BITS // 64) for r in rows])
            key = np.concatenate([r[3] for r in rows])
            who = back.astype(np.int32)[np.concatenate([r[4] + np.int32(s) for r, s in zip(rows, shift)])]
            place = np.concatenate([r[5] for r in rows])
            rows.clear()

            def once(parts, sig=sig):
                """Each pair of the bucket once, with one of its blocks."""
                code, block = (np.concatenate(x) for x in zip(*parts))
                code, first = np.unique(code, return_index=True)
                return code, block[first]

            def out(code, block, sig=sig):
                x, y = sig[code // len(sig)], sig[code % len(sig)]
                return pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["block", "x", "y"])

            def in_parts(key=key, who=who, place=place, size=size, lead=lead):
                part = ((key >> U64(20)) % U64(PARTS)).astype(np.uint8)
                for k in range(PARTS):
                    own = part == k
                    yield from list_pairs(key[own], who[own], place[own], size, lead[:, :LEADERS], lead[:, LEADERS:], percent)

            parts, waiting = [], 0
            for block, i, j in in_parts():
                parts.append((np.minimum(i, j).astype(np.int64) * len(sig) + np.maximum(i, j), block))
                waiting += len(i)
                if waiting > 1_000_000:
                    parts = [once(parts)]
                    waiting = len(parts[0][0])
                    if waiting > 750_000:  # more than a task should hold: later stages drop what repeats
                        yield out(*parts[0])
                        parts, waiting = [], 0
            if parts:
                yield out(*once(parts))

    return arrow_map(postings.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket"), run, "block long, x long, y long")


def _close(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs, each in one block, whose full maps don't rule them out."""
    once = pairs.groupBy("x", "y").agg(F.min("block").alias("block"))
    asked = pairs.select(F.explode(F.array("x", "y")).alias("sig")).distinct()
    maps = table.where("n > 0").join(asked, "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    one, other = (maps.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"map{c}")) for c in "xy")

    def run(batches):
        for batch in batches:
            nx, ny = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            most = nx + ny - 2 * _need(nx + ny, percent)
            a, b = batch.column(4), batch.column(6)
            keep = [maps_apart(np.frombuffer(a[k].as_buffer(), U64), np.frombuffer(b[k].as_buffer(), U64)) <= m for k, m in enumerate(most.tolist())]
            yield batch.select(["block", "x", "y"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(once.join(one, "x").join(other, "y").select("block", "x", "y", "nx", "mapx", "ny", "mapy"), run, "block long, x long, y long")


class Known:
    """Sets that are described by what one of them lacks or has beyond a base set."""

    def __init__(self, base: np.ndarray):
        self.base = base
        self.less: dict[int, frozenset] = {}
        self.more: dict[int, frozenset] = {}

    def add(self, name: int, s: np.ndarray) -> bool:
        """Describe a set, unless it differs from the base in more than half of it."""
        inside = np.isin(self.base, s, assume_unique=True)
        both = int(inside.sum())
        if 2 * (len(self.base) + len(s) - 2 * both) > len(self.base):
            return False
        self.less[name] = frozenset(self.base[~inside].tolist())
        self.more[name] = frozenset(s[~np.isin(s, self.base, assume_unique=True)].tolist())
        return True

    def common(self, a: int, b: int) -> int:
        """The intersection's size, from what either set changes in the base."""
        la, lb = self.less[a], self.less[b]
        return len(self.base) - len(la) - len(lb) + len(la & lb) + len(self.more[a] & self.more[b])


def _checked(rows: DataFrame, percent: int, partitions: int) -> DataFrame:
    """The pairs that are similar enough; each block's rows come together: its sets (``data``), its pairs (``y``)."""

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        pairs: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for block, x, y, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if data is not None:
                    sets.setdefault(x, np.frombuffer(data, U64))
                else:
                    pairs.setdefault(block, []).append((x, y))
        out_x, out_y = [], []
        for own in pairs.values():
            known, described = None, {}
            members = {k for p in own for k in p}
            if len(own) > 3:
                base = max(members, key=lambda k: sum(k in p for p in own[:64]))
                known = Known(sets[base])
                described = {k for k in members if known.add(k, sets[k])}
            for x, y in own:
                total = len(sets[x]) + len(sets[y])
                both = known.common(x, y) if known and x in described and y in described else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (total - both):
                    out_x.append(x)
                    out_y.append(y)
        if out_x:
            yield pa.RecordBatch.from_arrays([pa.array(out_x, pa.int64()), pa.array(out_y, pa.int64())], names=["x", "y"])

    return arrow_map(rows.repartition(partitions, "block"), run, "x long, y long").distinct()


def similar(docs: DataFrame, width: int = 3, percent: int = 70, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Exact links of near-equal documents: the id, ``n_shingles``, ``n_similar``, ``component_id``; a row for each row.

    A document's set is its distinct ``width``-word shingles (see
    ``textops.shingle_sets``; letters A-Z as a-z).  Two documents are linked if
    ``100 * intersection >= percent * union``.  ``n_similar`` counts the other
    rows that a row is linked with directly, ``component_id`` is the least id
    that links reach.  Shingles and sets are told apart by 64-bit hashes.

    What moves: by document an id and a signature; by class of equal sets the
    prefix's postings (map-side, copies in one task once); the sets of classes
    that are in a candidate pair.  A list of very many sets is checked in
    blocks of ``BLOCK``, and the rows of a large class are never brought
    together: they count by their class's size.  Nothing is capped.

    Texts without words, and nulls, are linked with nothing and are their own
    component.  Repeated rows are linked with each other.  A row without an id
    counts as a neighbour, and has the least id of the others as component, or
    null.  Other columns don't matter; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    table, known, times = signatures(source, "id", "text", width)
    classes = table.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    total = table.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("p")).first()["p"] or 0
    parallel = shuffle_partitions(spark)
    buckets = int(max(LEAST_BUCKETS, -(-total // BUCKET_POSTINGS)))
    order = spark.sparkContext.broadcast((known, times))
    found = stored(_candidates(_postings(source, "id", "text", width, percent, order, buckets), buckets, percent))
    pairs = stored(_close(found, table, percent))
    discard(found)
    # the classes in question, each by the text of its least id
    ends = pairs.select("block", F.explode(F.array("x", "y")).alias("sig")).distinct()
    asked = stored(ends.select("sig").distinct().join(classes, "sig").join(table.groupBy("sig").agg(F.first("n").alias("n")), "sig"))
    n_asked = asked.count()
    wanted = asked.select("sig", F.col("rep").alias("id"))
    if n_asked <= BROADCAST_CLASSES:
        sent = wanted.toPandas()
        sig_of = np.sort(sent["sig"].to_numpy(np.int64))
        chosen = spark.sparkContext.broadcast(sig_of)
        scan = source.join(F.broadcast(wanted.select("id")), "id", "left_semi") if n_asked < 200_000 and not sent["id"].isna().any() else source
    else:
        chosen = None
        scan = source.join(wanted.where("id is not null").select("id").distinct(), "id", "left_semi")
        if not wanted.where("id is null").isEmpty():  # classes of rows that all lack an id
            scan = scan.unionByName(source.where("id is null"))

    def asked_sets(batches):
        only = chosen.value if chosen else None
        for batch in batches:
            for _, sets, edges in _sets(batch.column(1), width):
                rows = {}
                for i in range(len(edges) - 1):
                    s = sets[edges[i] : edges[i + 1]]
                    if len(s):
                        sig = _signature(s)
                        k = np.searchsorted(only, sig) if only is not None else 0
                        if only is None or k < len(only) and only[k] == sig:
                            rows.setdefault(sig, s.tobytes())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["sig", "data"])

    sets = arrow_map(scan.select("id", "text"), asked_sets, "sig long, data binary")
    ends_n = ends.join(asked.select("sig", "n"), "sig")
    weight = ends_n.agg(F.sum("n").alias("n")).first()["n"] or 0
    partitions = int(max(parallel, -(-8 * weight // SETS_BYTES)))
    members = ends.join(sets, "sig").select("block", F.col("sig").alias("x"), F.lit(None).cast("long").alias("y"), "data")
    rows = members.unionByName(pairs.select("block", "x", "y", F.lit(None).cast("binary").alias("data")))
    links = stored(_checked(rows, percent, partitions))
    discard(pairs)
    # back to documents
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    size = asked.select("sig", "rep", F.col("rows"))
    counted = both.join(size.select(F.col("sig").alias("y"), "rows"), "y").groupBy(F.col("x").alias("sig")).agg(F.sum("rows").alias("others"))
    edge = links.join(size.select(F.col("sig").alias("x"), F.col("rep").alias("u")), "x").join(size.select(F.col("sig").alias("y"), F.col("rep").alias("v")), "y")
    reached = components(edge.select("u", "v").where("u is not null and v is not null"))
    by_class = classes.join(counted, "sig", "left").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("sig", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("near"), F.coalesce("component", "rep").alias("component"))
    out = table.drop("map").join(by_class, "sig", "left")
    return out.select(F.col("id").cast(kind).alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("near", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, percent: int = 70, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, one document of each component: that of the least id.

    Rows that repeat an id are one document.  Rows without an id all stay.
    """
    found = similar(docs, width, percent, id_column, text_column)
    keep = found.where(F.col(id_column) == F.col("component_id")).select(id_column).distinct()
    kept = docs.where(F.col(id_column).isNotNull()).join(keep, id_column, "left_semi").dropDuplicates([id_column]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_column).isNull()))
