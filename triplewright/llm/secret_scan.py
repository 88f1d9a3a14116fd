"""Secret scans: patterns, and strings that zstandard finds new against dictionaries and their surroundings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from triplewright.llm.common import arrow_map
from triplewright.llm.textops import as_texts, slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: What follows a "=" within a candidate, with its padding.
VALUE = re.compile(r"(?<==)[A-Za-z0-9+/_~-]{16,}(?:=+(?![A-Za-z0-9+/_~-]))?")
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|login", re.IGNORECASE | re.ASCII)

_WORDS = [w.encode() for w in ("passw", "secret", "token", "apikey", "api_key")]
_HEX_LUT = np.zeros(256, bool)
_HEX_LUT[[*b"0123456789abcdef"]] = True
_RUN_LUT = np.zeros(256, bool)
_RUN_LUT[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=~-"]] = True

#: Bytes of text searched at once.
STEP = 1 << 20

#: What code and prose commonly hold; a candidate built of this compresses away.
IDENTIFIERS = " ".join(
    """abstract access_token admin api_key application argument array async authorization await background base64 boolean
    bucket buffer bytes cache callback certificate char class client client_id client_secret collection column config
    configuration connection connection_string console const constructor content content_type context controller cookie
    counter create credential credentials database datetime debug default delete description destination document
    double element encoding endpoint environment example exception export expression extends filename filter float
    folder foreach format function generator getElementById global handler hash header headers height hostname
    https://www. http://localhost identifier image implements import index infinite initialize input insert instance
    integer interface internal iterator javascript keyword lambda language length library license listener localhost
    location logger manager message metadata method middleware module multipart namespace null number object operator
    option organization output package parameter parser password path pattern payload permission placeholder pointer
    port position prefix primary_key private private_key process production profile project property protected protocol
    provider public public_key query random readonly receiver record redirect reference refresh_token region register
    repository request require response result return router schema script secret secret_key security select sender
    sequence server service session session_id setting signature source static status string struct subscription suffix
    switch table target template test_user thread timeout timestamp token transaction transform trigger typedef
    undefined unsigned update upload user user_id username utility validate value variable vector version virtual void
    volatile warning width window workspace your_api_key_here your_secret_here changeme xxxxxxxxxxxxxxxx 0123456789
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 the and that with this from have which
    would there their about could other into than then them these some""".split()
).encode()


class Novelty:
    """Marginal compressed bytes of a string, primed with identifiers and its surroundings."""

    def __init__(self, level: int = 3):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def share(self, around: str, candidate: str) -> float:
        """Bits that the candidate adds to its surroundings, against those of a random string over its characters."""
        kinds = 10 * any(c.isdigit() for c in candidate) + 26 * any(c.islower() for c in candidate) + 26 * any(c.isupper() for c in candidate) + 2 * any(not c.isalnum() for c in candidate)
        if all(c in "0123456789abcdefABCDEF" for c in candidate):
            kinds = min(kinds, 16)
        base = around.encode("utf-8", "replace")
        more = len(self.press(base + b"\n" + candidate.encode("utf-8", "replace"))) - len(self.press(base + b"\n"))
        return 8 * more / (len(candidate) * np.log2(max(2, kinds)))


_NOVELTY: list[Novelty] = []


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The three patterns' spans in code points: leftmost and not overlapping by kind; those too short are dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], threshold: float, reach: int) -> list[tuple[int, int, str]]:
    """Further strings in sensitive places that don't compress."""
    if not _NOVELTY:
        _NOVELTY.append(Novelty())
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        name = SENSITIVE.search(text, max(0, a - 48), b)
        if not name:
            continue
        rest, at = [], a  # what base spans leave of it
        for s, e in sorted((s, e) for s, e, _ in taken if s < b and a < e):
            rest.append((at, s))
            at = max(at, e)
        rest = [(s, e) for s, e in [*rest, (at, b)] if e - s >= 16]
        whole = 0
        for s, e in [x for r in rest for x in (r, *(v.span() for v in VALUE.finditer(text, *r)))]:
            if e <= whole:
                continue  # a value in what is reported
            word = text[s:e]
            if name.end() > s or not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
                continue
            around = text[max(0, s - reach) : s] + " " + text[e : e + reach]
            if _NOVELTY[0].share(around, word) >= threshold:
                out.append((s, e, "novel"))
                whole = e
    return out


def _long_run(mask: np.ndarray, least: int, offsets: np.ndarray) -> np.ndarray:
    """Texts in which ``mask`` holds for ``least`` bytes on end (a run that crosses into the next text counts for both)."""
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= least
    hit = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(np.searchsorted(offsets, starts[long], "right") - 1, np.searchsorted(offsets, ends[long] - 1, "right") - 1):
        hit[a : b + 1] = True
    return hit


def find_spans(column: pa.Array, threshold: float, reach: int):
    """The spans of each text of a column, sorted by start and then kind."""
    rank = {k: i for i, k in enumerate(KINDS)}
    for a, b in slices(column, STEP):
        texts = as_texts(column.slice(a, b - a))
        data, offsets = texts
        lower = data.tobytes().lower()
        hit = np.zeros(len(texts), bool)
        for word in [*_WORDS, b"akia"]:
            k = lower.find(word)
            while k >= 0:
                row = int(np.searchsorted(offsets, k, "right")) - 1
                hit[row] = True
                k = lower.find(word, int(offsets[row + 1]))  # on to the next text
        hit |= _long_run(_HEX_LUT[data], 24, offsets)
        maybe = _long_run(_RUN_LUT[data], 16, offsets)
        for k in range(len(texts)):
            if not (hit[k] or maybe[k]):
                yield []
                continue
            text = texts.text(k)
            found = base_spans(text) if hit[k] else []
            if maybe[k]:
                found += novel_spans(text, found, threshold, reach)
            yield sorted(found, key=lambda s: (s[0], rank[s[2]], s[1]))


def scan(docs: DataFrame, threshold: float = 0.8, reach: int = 256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The secrets in every whole text: one row for each input row, with ``secrets``, an array of (kind, start, end).

    Kinds ``assign``, ``access`` and ``hex`` are the patterns above.  ``novel``
    spans are further strings of 16 characters and more with letters and
    digits, in a sensitive place (a word such as ``auth`` in the 48 characters
    before), or values after a ``=`` with such a word in the name, whose marginal size under zstandard - primed with an identifier
    dictionary and ``reach`` characters of surroundings on either side - is at
    least ``threshold`` of what a random string over the same kinds of
    characters would need.  Positions are code points, ends exclusive.

    There is no shuffle; each row is judged alone.  A null text is empty and
    holds nothing; repeated rows give equal rows; null ids stay null; other
    columns don't matter; an empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in found] for found in find_spans(batch.column(1), threshold, reach)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=[id_column, "secrets"])

    return arrow_map(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, secrets array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.8, reach: int = 256, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, with every secret of the text replaced by ``mark``.

    Overlapping spans are replaced as one.  ``length_column``, where it
    exists, is set to the new text's code points if the text changed.  A null
    text stays null; repeated rows change alike; an empty table stays empty.
    """
    names = docs.columns
    text_at = names.index(text_column)
    length_at = names.index(length_column) if length_column in names else None

    def run(batches):
        for whole in batches:
            for a, b in slices(whole.column(text_at), STEP):
                batch = whole.slice(a, b - a)
                column, changed = batch.column(text_at), {}
                for k, found in enumerate(find_spans(column, threshold, reach)):
                    if found:
                        text, out, at = column[k].as_py(), [], 0
                        for s, e, _ in found:
                            if s >= at:
                                out += [text[at:s], mark]
                            at = max(at, e)
                        changed[k] = "".join(out) + text[at:]
                arrays = list(batch.columns)
                if changed:
                    new = column.to_pylist()
                    for k, text in changed.items():
                        new[k] = text
                    arrays[text_at] = pa.array(new, column.type)
                    if length_at is not None:
                        sizes = batch.column(length_at).to_pylist()
                        for k, text in changed.items():
                            sizes[k] = len(text)
                        arrays[length_at] = pa.array(sizes, batch.column(length_at).type)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql.types import StructType

    return arrow_map(docs, run, StructType(docs.schema.fields))
