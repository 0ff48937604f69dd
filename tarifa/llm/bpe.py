"""Byte-level BPE encoding and decoding by a rank file, with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import functools
import itertools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import by_place

LEAF = 8                 # ranks per leaf bitmap: 2^LEAF
LOW = (1 << LEAF) - 1
CACHE = 300_000          # words and pre-tokens a worker remembers; past that it starts afresh
PORTION = 4 << 20        # bytes of text encoded together


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: merges the lowest rank first, leftmost first among equals.

    Positions of mergeable pairs wait in one bucket per rank; a two-level bitmap marks the buckets that
    hold any, so the next rank is two find-first-set steps however long the piece is. Tokens form a linked
    list over the byte positions. A merge changes its neighbours' pairs; the entries they leave behind in
    other buckets are stale (``rank`` no longer agrees) and are skipped when met."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [get(piece[i:i + 2], -1) for i in range(n)]         # of the pair that starts at a position
    rank[n - 1] = -1
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for i, r in enumerate(rank):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                h = r >> LEAF
                leaves[h] = leaves.get(h, 0) | 1 << (r & LOW)
                top |= 1 << h
    while top:
        h = (top & -top).bit_length() - 1
        leaf = leaves[h]
        bit = leaf & -leaf
        r = h << LEAF | bit.bit_length() - 1
        leaves[h] = leaf ^ bit
        if leaf == bit:
            top ^= 1 << h
        todo = buckets.pop(r)
        if len(todo) > 1:
            todo.sort()
        for at, i in enumerate(todo):
            if rank[i] != r:
                continue
            j = nxt[i]
            k = nxt[j]
            nxt[i] = k
            rank[j] = q = -1
            if k < n:
                prv[k] = i
                q = get(piece[i:nxt[k]], -1)
            rank[i] = q
            p = prv[i]
            new = (i,)
            if p >= 0:
                rank[p] = get(piece[p:k], -1)
                new = (i, p)
            least = r
            for x in new:
                q = rank[x]
                if q >= 0:
                    if q in buckets:
                        buckets[q].append(x)
                    else:
                        buckets[q] = [x]
                        h = q >> LEAF
                        leaves[h] = leaves.get(h, 0) | 1 << (q & LOW)
                        top |= 1 << h
                    if q < least:
                        least = q
            if least < r:              # a lower rank came up: it goes before the rest of this bucket
                rest = [x for x in todo[at + 1:] if rank[x] == r]
                if rest:
                    buckets[r] = rest
                    h = r >> LEAF
                    leaves[h] |= 1 << (r & LOW)
                    top |= 1 << h
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:nxt[i]]])
        i = nxt[i]
    return ids


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Table:
    """Ranks for arrays: which merged rank two neighbouring ids make, from every split of every token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int64)
        keys, made = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ranks, -1 where the ids don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1) if len(self.keys) else np.full(len(key), -1)


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], table: Table) -> list[bytes]:
    """Packed ids of many pre-tokens by one rank queue: a bucket holds the positions of its rank in all of them, and is
    merged as arrays. Pre-tokens don't touch, so taking the lowest rank of all first changes nothing for any of them. In the
    rare case that a merge makes a pair of a lower rank possible, its pre-token is left to ``merge``, which minds the order."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces], np.int64)      # none is empty
    n, ends = int(lengths.sum()), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    tok = table.single[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends - 1] = prv[ends - lengths] = -1
    rank = np.full(n + 1, -1)
    some = np.flatnonzero(nxt >= 0)
    rank[some] = table.pair(tok[some], tok[some + 1])
    alive, mark, careful = np.ones(n, bool), np.zeros(n + 1, bool), np.zeros(len(pieces), bool)
    buckets: dict[int, list[np.ndarray]] = {}
    leaves: dict[int, int] = {}
    top = 0

    def push(at: np.ndarray, r: np.ndarray) -> None:
        nonlocal top
        order = np.argsort(r, kind="stable")
        r = r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for q, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at[order], cuts), strict=True):
            if q in buckets:
                buckets[q].append(part)
            else:
                buckets[q] = [part]
                h = q >> LEAF
                leaves[h] = leaves.get(h, 0) | 1 << (q & LOW)
                top |= 1 << h

    some = some[rank[some] >= 0]
    if len(some):
        push(some, rank[some])
    while top:
        h = (top & -top).bit_length() - 1
        leaf = leaves[h]
        bit = leaf & -leaf
        r = h << LEAF | bit.bit_length() - 1
        leaves[h] = leaf ^ bit
        if leaf == bit:
            top ^= 1 << h
        todo = buckets.pop(r)
        i = todo[0] if len(todo) == 1 else np.unique(np.concatenate(todo))
        i = i[rank[i] == r]                              # the others are stale
        if not len(i):
            continue
        mark[i] = True
        if mark[nxt[i]].any():                           # pairs that share a token: the left one goes first
            taken = []
            for x in np.sort(i).tolist():
                if mark[x]:
                    taken.append(x)
                    mark[nxt[x]] = False
            mark[i] = False
            i = np.array(taken)
        mark[i] = False
        j = nxt[i]
        k = nxt[j]
        nxt[i], tok[i], alive[j] = k, r, False
        rank[i] = rank[j] = -1
        right = i[k >= 0]
        prv[k[k >= 0]] = right
        left = prv[i]
        left = left[left >= 0]
        new = np.concatenate([right, left])
        if len(new):
            q = table.pair(tok[new], tok[nxt[new]])
            rank[new] = q
            ok = q >= 0
            if ok.any():
                new, q = new[ok], q[ok]
                low = q < r
                if low.any():
                    careful[owner[new[low]]] = True
                push(new, q)
    raw = tok[alive].astype("<u4").tobytes()
    stops = np.cumsum(np.add.reduceat(alive, ends - lengths, dtype=np.int64)) * 4
    got = [raw[a:e] for a, e in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
    for x in np.flatnonzero(careful).tolist():
        got[x] = _pack(merge(pieces[x], ranks))
    return got


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes, remembering pieces already encoded.

    No pre-token of the pattern runs from a non-space character into a space, so a text whose words are
    set apart by single spaces may be cut before each space; other texts go through the pattern whole."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.table = Table(self.ranks)
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, tokens) -> None:
        new, ranks = [t for t in dict.fromkeys(tokens) if t not in self.parts], self.ranks
        raw = [t.encode() for t in new]
        whole = [ranks.get(p) for p in raw]
        got = iter(merge_many([p for p, w in zip(raw, whole, strict=True) if w is None], ranks, self.table))
        self.parts.update((t, _pack([w]) if w is not None else next(got)) for t, w in zip(new, whole, strict=True))

    def _clean(self, word: str) -> bool:
        return bool(word) and not self.space(word[0]) and not self.space(word[-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE or len(self.parts) > CACHE:
            self.words.clear()
            self.parts.clear()
        words, cut, whole, new = self.words, [], {}, {}
        for n, text in enumerate(texts):
            ws = text.split(" ")
            fresh = [w for w in ws[1:] if w not in words]
            if not self._clean(ws[0]) or not all(map(self._clean, fresh)):
                whole[n] = self.find(text)
                cut.append(None)
                continue
            new.update(dict.fromkeys(fresh))
            whole[n] = self.find(ws[0])                  # the first word has no space before it
            cut.append(ws)
        tokens = self.find("".join([f" {w}" for w in new]))
        self._learn(itertools.chain(tokens, itertools.chain.from_iterable(whole.values())))
        parts = self.parts
        starts = [i for i, t in enumerate(tokens) if t[0] == " "]     # each word gives one token with the space, its first
        packed = list(map(parts.__getitem__, tokens))
        for w, a, e in zip(new, starts, starts[1:] + [len(tokens)] * bool(starts), strict=True):
            words[w] = packed[a] if e - a == 1 else b"".join(packed[a:e])
        out = []
        for n, ws in enumerate(cut):
            head = b"".join(map(parts.__getitem__, whole[n]))
            out.append(head if ws is None else head + b"".join(map(words.__getitem__, ws[1:])))
        for t in [t for t in itertools.chain.from_iterable(whole.values()) if len(t) > 64]:
            parts.pop(t, None)                           # very long pieces are not remembered
        for w in [w for w in new if len(w) > 64]:
            words.pop(w, None)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _columns(df: DataFrame, col: str, out: dict, text: bool) -> DataFrame:
    """``df`` with binary columns made from ``col``; ``out``: name -> maker of a function that turns a list of values, from
    the second on the earlier results, into another. Rows are worked on by about PORTION bytes."""
    def run(batches):
        fs = {k: make() for k, make in out.items()}
        for b in batches:
            source = b.column(b.schema.get_field_index(col))
            for at, n in _portions(source):
                value = [("" if text else b"") if v is None else v for v in source.slice(at, n).to_pylist()]
                made = []
                for f in fs.values():
                    value = f(value)
                    made.append(pa.array(value, pa.binary()))
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *fs])

    return df.mapInArrow(run, StructType(df.schema.fields + [StructField(k, BinaryType()) for k in out]))


def _portions(source: pa.Array):
    """(first, count) of runs of rows of about PORTION bytes."""
    sizes = np.cumsum([0] + [len(v) for v in source.cast(pa.binary()).fill_null(b"").to_pylist()])
    at = 0
    while at < len(source):
        n = max(1, int(np.searchsorted(sizes, sizes[at] + PORTION, side="right")) - 1 - at)
        yield at, n
        at += n


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of the whole text as little-endian unsigned 32-bit integers. A null or
    empty text has no ids. Every row stays, extra columns pass through, whatever their names (where one is called ``out``, the new
    column gets an underscore); no special tokens."""
    return by_place(df, [text_col], lambda d, t: _columns(d, t, {out: lambda: encoder(path, pattern).encode}, True), (out,))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that ``ids_col`` stands for (null: none)."""
    def make():
        tokens = vocabulary(path)
        return lambda many: [decode(ids, tokens) for ids in many]

    return _columns(df, ids_col, {out: make}, False)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass: adds ``ids`` and ``decoded``."""
    def back():
        tokens = vocabulary(path)
        return lambda many: [decode(ids, tokens) for ids in many]

    return _columns(df, text_col, {"ids": lambda: encoder(path, pattern).encode, "decoded": back}, True)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    d = round_trip(df.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
