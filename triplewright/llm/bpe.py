"""Byte-level BPE over Arrow batches, without a Python object per pre-token.

Pre-tokens are cut by character class with numpy, hashed, and looked up in two
tiers: a compact hash table of frequent pre-tokens that is sent with the task,
where one or two array reads answer for each, and a cache that lives as long as
the Python worker.  Only what both miss is encoded, once per worker.  Texts that hold an apostrophe
or a special token go through the library's own rules (``regex`` plus the same
caches), since contractions depend on where a token starts.
"""

from __future__ import annotations

import importlib
import json
import os
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import regex

from triplewright.llm.textops import U64, Texts, span_hashes

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, BLANK, SPACE = 1, 2, 3, 4, 5
#: Pre-tokens that a worker's cache holds before it starts anew.
CACHE_LIMIT = 200_000


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; a path is taken as it is."""
    if os.path.sep in name:
        return name
    return importlib.import_module("public_tokenizers").path(name)


def _classes() -> np.ndarray:
    """The class of every code point for the pattern."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[32] = SPACE
    return out


class Frequent(NamedTuple):
    """The first tier: hashes of pre-tokens, their ids ``ids[at[k]:at[k + 1]]``, and the table that finds a hash's place.

    A hash has two places in ``table``, by its high and its low bits; a
    pre-token that finds both taken is left to the second tier.
    """

    keys: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Frequent:
        bits = max(4, int(4 * len(keys)).bit_length())
        table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # of several the first one stays
        for where in (keys >> U64(64 - bits), keys & U64((1 << bits) - 1)):
            where = where.astype(np.int64)
            left = left[table[where[left]] < 0]
            table[where[left]] = left
            left = left[table[where[left]] != left]
        return cls(keys, ids, at, table)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys; -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        bits = len(self.table).bit_length() - 1
        at = self.table[(h >> U64(64 - bits)).astype(np.int64)]
        out = np.where((at >= 0) & (self.keys[at] == h), at, -1)
        rest = np.flatnonzero(out < 0)
        at = self.table[(h[rest] & U64((1 << bits) - 1)).astype(np.int64)]
        out[rest] = np.where((at >= 0) & (self.keys[at] == h[rest]), at, -1)
        return out.astype(np.int64)


NONE = Frequent.of(np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(1, np.int64))


class Encoder:
    """Token ids or counts of texts for a byte-level BPE file, equal to the library's.

    Special strings inside a text become their token, as is the library's
    default; nothing is added, cut or padded.
    """

    def __init__(self, path: str, frequent: Frequent = NONE):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on their surroundings")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.special_bytes = [t.encode() for t in self.special]
        self.fast = self._ranks(spec)
        self.classes = _classes()
        self.ascii = self.classes[:256].copy()
        self.frequent = frequent
        self.clear()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, spec: dict):
        """The merges as ranks, where ids are in merge order: the same ids, several times sooner."""
        try:
            import tiktoken
        except ImportError:
            return None
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves
        alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in vocab.items()}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def clear(self) -> None:
        """Start the second tier anew; the first one stays."""
        first = self.frequent
        self.slot: dict[int, int] = {}
        self.slots = len(first.keys)
        self.ids = np.concatenate([first.ids, np.zeros(1 << 16, np.uint32)])
        self.at = np.concatenate([first.at, np.zeros(1 << 15, np.int64)])  # where a slot's ids begin

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if self.fast:
            found = list(map(self.fast, pieces))
        else:
            found = [e.ids for e in self.library.encode_batch([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        n, used = self.slots, int(self.at[self.slots])
        need = used + int(sizes.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids)), np.uint32)])
        if n + len(found) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(n + len(found) + 1 - len(self.at), len(self.at)), np.int64)])
        self.ids[used:need] = [i for x in found for i in x]
        self.at[n + 1 : n + len(found) + 1] = used + np.cumsum(sizes)
        self.slot.update(zip(keys.tolist(), range(n, n + len(found))))
        self.slots = n + len(found)

    def _cuts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where pre-tokens begin, and the class array."""
        data, offsets = texts
        kind = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b0 = data[lead].astype(np.int64)
            wide = 1 + (b0 >= 0xE0).astype(np.int64) + (b0 >= 0xF0)
            more = [np.where(wide >= k, data[np.minimum(lead + k, len(data) - 1)] & 0x3F, 0).astype(np.int64) for k in (1, 2, 3)]
            point = np.where(wide == 1, (b0 & 0x1F) << 6 | more[0], np.where(wide == 2, (b0 & 0x0F) << 12 | more[0] << 6 | more[1], (b0 & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
            what = self.classes[np.minimum(point, 0x10FFFF)]
            kind[lead] = what
            for k in (1, 2, 3):
                has = wide >= k
                kind[lead[has] + k] = what[has]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        blank = kind >= BLANK
        begin = first[:n].copy()  # a text's first byte
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        before = np.zeros(n, bool)  # the byte before is a blank of the same text
        before[1:] = blank[:-1]
        before &= ~begin
        space = np.zeros(n, bool)  # that byte is a plain space
        space[1:] = kind[:-1] == SPACE
        space &= ~begin
        begin |= ~blank & change & ~space  # a run of one class, unless a space before belongs to it
        begin |= blank & ~before  # a run of blanks
        # the last blank of a run, before something else, stands apart
        last = np.zeros(n, bool)
        last[:-1] = ~blank[1:]
        last &= ~first[1:]
        head = np.ones(n, bool)  # first byte of a character
        head &= (data & 0xC0) != 0x80
        apart = blank & last
        if len(lead) and (self.wide_blank(data, apart)):
            where = np.flatnonzero(apart)
            apart[where] = False
            while len(where):
                done = head[where]
                apart[where[done]] = True
                where = where[~done] - 1
        begin |= apart & head
        return np.flatnonzero(begin), kind

    @staticmethod
    def wide_blank(data: np.ndarray, apart: np.ndarray) -> bool:
        return bool((data[apart] >= 0x80).any())

    def _slots(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every pre-token, and where each text's begin."""
        starts, _ = self._cuts(texts)
        ends = np.append(starts[1:], len(texts.data))
        h = span_hashes(texts.data, starts, ends, fold=False)
        slots = self.frequent.find(h)
        rest = np.flatnonzero(slots < 0)
        if len(rest):
            keys, where, back = np.unique(h[rest], return_index=True, return_inverse=True)
            if len(self.slot) + len(keys) > CACHE_LIMIT and self.slot:
                self.clear()
            get = self.slot.get
            found = np.array([get(k, -1) for k in keys.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                raw = texts.data.tobytes()
                a, b = starts[rest[where[new]]].tolist(), ends[rest[where[new]]].tolist()
                n = self.slots
                self._learn(keys[new], [raw[i:j] for i, j in zip(a, b)])
                found[new] = np.arange(n, n + len(new))
            slots[rest] = found[back]
        return slots, np.searchsorted(starts, texts.offsets)

    def _odd(self, texts: Texts) -> np.ndarray:
        """Texts that the class rules don't cover."""
        sums = np.concatenate([[0], np.cumsum(texts.data == 39)])
        odd = sums[texts.offsets[1:]] > sums[texts.offsets[:-1]]
        if self.special_bytes and (texts.data == 124).any():
            raw = texts.data.tobytes()
            for token in self.special_bytes:
                k = raw.find(token)
                while k >= 0:
                    odd[np.searchsorted(texts.offsets, k, "right") - 1] = True
                    k = raw.find(token, k + 1)
        return odd

    def _pieces(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens by the pattern; special tokens as their ids at the same places, else -1."""
        pieces, ids = [], []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                pieces.append(part)
                ids.append(self.special[part])
            elif part:
                found = self.pattern.findall(part)
                pieces += found
                ids += [-1] * len(found)
        return pieces, ids

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        if not len(texts.data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        odd = self._odd(texts)
        if odd.any():  # those one by one, the rest between them together
            parts, sizes = [], []
            edges = np.flatnonzero(np.diff(odd.astype(np.int8))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)]):
                own = Texts(texts.data[texts.offsets[a] : texts.offsets[b]], texts.offsets[a : b + 1] - texts.offsets[a])
                if odd[a]:
                    for k in range(b - a):
                        ids = self._encode_odd(own.text(k))
                        parts.append(ids)
                        sizes.append([len(ids)])
                else:
                    ids, at = self.encode(own)
                    parts.append(ids)
                    sizes.append(np.diff(at))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        slots, first = self._slots(texts)
        begin, size = self.at[slots], self.at[slots + 1] - self.at[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(begin - total[:-1], size) + np.arange(total[-1])
        return self.ids[index], total[first]

    def _encode_odd(self, text: str) -> np.ndarray:
        pieces, special = self._pieces(text)
        raw = [p.encode("utf-8", "replace") for p in pieces]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        keys = span_hashes(data, np.concatenate([[0], ends[:-1]]), ends, fold=False)
        get, out = self.slot.get, []
        for key, piece, one, k in zip(keys.tolist(), raw, special, self.frequent.find(keys).tolist()):
            if one >= 0:
                out.append(np.array([one], np.uint32))
                continue
            k = k if k >= 0 else get(key)
            if k is None:
                k = self.slots
                self._learn(np.array([key], U64), [piece])
            out.append(self.ids[self.at[k] : self.at[k + 1]])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def count(self, texts: Texts) -> np.ndarray:
        """Tokens of each text."""
        if not len(texts.data):
            return np.zeros(len(texts), np.int64)
        odd = self._odd(texts)
        if odd.any():
            return np.diff(self.encode(texts)[1])
        slots, first = self._slots(texts)
        total = np.concatenate([[0], np.cumsum(self.at[slots + 1] - self.at[slots])])
        return np.diff(total[first])


def frequent_of(path: str, pieces: list[bytes]) -> Frequent:
    """The first tier for these pre-tokens, the most frequent first."""
    encoder = Encoder(path)
    if not pieces:
        return NONE
    ends = np.cumsum([len(r) for r in pieces])
    keys = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends[:-1]]), ends, fold=False)
    encoder._learn(keys, pieces)
    return Frequent.of(keys, encoder.ids[: encoder.at[encoder.slots]].copy(), encoder.at[: encoder.slots + 1].copy())


@lru_cache(4)
def vocabulary_table(path: str) -> Frequent:
    """A first tier without a look at the corpus: the vocabulary's own entries that are pre-tokens, about 1 MB.  Made once for each file."""
    encoder = Encoder(path)
    pieces = set()
    for k in range(encoder.library.get_vocab_size(with_added_tokens=False)):
        piece = encoder.library.decode([k], skip_special_tokens=False)
        if piece and "�" not in piece and "'" not in piece and piece not in encoder.special and encoder.pattern.findall(piece) == [piece]:
            pieces.add(piece)
    return frequent_of(path, [p.encode() for p in sorted(pieces)])


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str, frequent: Frequent = NONE) -> Encoder:
    """This process's encoder for a file; its cache outlives a task, unless the first tier is another one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = _ENCODERS.get(path)
    if own is None:
        own = _ENCODERS[path] = Encoder(path, frequent)
    elif not np.array_equal(own.frequent.keys, frequent.keys):
        own.frequent = frequent
        own.clear()
    return own
