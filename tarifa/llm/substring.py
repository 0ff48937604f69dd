"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, key_filter, maybe_in, scratch_path

WINDOW = 13
BLOCK_WORDS = 1 << 20    # words whose windows a task holds at a time
LAST = (1 << 63) - 1     # order of a null id: after all others


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length``-word windows at each word but the last ``length - 1``, by doubling the word hashes
    ``h``: two windows side by side, or overlapping, make the longer one."""
    size = 1
    while size < length and len(h):
        step = min(size, length - size)
        h = _mix(h[:len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h[:0]
        size += step
    return h


def levels(window: int) -> list[int]:
    """Half the window (rounded up), then twice that, cut to the window."""
    return [-(-window // 2), window] if window > 1 else [1]


def _picked(seeds: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the smallest of the ``width`` seeds inside it; and the seeds so chosen by any valid window.
    Equal windows choose equal seeds at equal places, so a window can only repeat where its seeds do."""
    n = len(seeds) - width + 1
    least = np.min(np.lib.stride_tricks.sliding_window_view(seeds, width), axis=1) if n > 0 else seeds[:0]
    chosen = np.zeros(len(seeds), bool)
    for j in range(width):
        if n > 0:
            chosen[j:j + n] |= (seeds[j:j + n] == least) & valid[:n]
    return least, chosen


class Block:
    """Word hashes of some documents, end to end."""

    def __init__(self, texts: list, window: int):
        self.words = [(t or b"").split() for t in texts]           # bytes: the six ASCII white-space characters only
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        digest = xxhash.xxh64_intdigest
        self.h = np.fromiter((digest(w) for w in itertools.chain.from_iterable(self.words)), np.uint64, total)
        self.left = np.repeat(self.start + self.n, self.n) - np.arange(total)      # words to the document's end
        self.seed_len, self.window = levels(window)[0], window
        self.seeds = _windows(self.h, self.seed_len)
        self.wide = _windows(self.h, window)
        self.valid = self.left[:len(self.wide)] >= window
        self.least, self.chosen = _picked(self.seeds, self.valid, window - self.seed_len + 1)

    def candidates(self, found: list[np.ndarray]) -> np.ndarray:
        """Places of the windows whose smallest seed is among the places ``found`` in each document."""
        seen = np.zeros(len(self.seeds), bool)
        for at, n, f in zip(self.start.tolist(), self.n.tolist(), found, strict=True):
            seen[at + f[f <= n - self.seed_len]] = True          # places of another document with the same tag may lie outside
        ok = np.zeros(len(self.wide), bool)
        for j in range(self.window - self.seed_len + 1):
            ok |= seen[j:j + len(ok)] & (self.seeds[j:j + len(ok)] == self.least[:len(ok)])
        return np.flatnonzero(ok & self.valid)


def _blocks(batches, text_at: int):
    """(rows, texts) of at most about BLOCK_WORDS words; a longer document is a block of its own."""
    for b in batches:
        texts = b.column(text_at).cast(pa.string()).cast(pa.binary()).to_pylist()
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"") // 2
            if size >= BLOCK_WORDS:
                yield b.slice(first, i + 1 - first), texts[first:i + 1]
                first, size = i + 1, 0
        if first < len(texts):
            yield b.slice(first), texts[first:]


ROWS = "bucket int, hash binary, ord binary, doc binary, at binary, sure_doc binary, sure_at binary"
TAG = (1 << 32) - 1      # level one names a document by the low 32 bits of its key: a clash only brings in one more document


def _pack_at(at: np.ndarray) -> bytes:
    """Places as low, then high 16-bit halves: the high ones are mostly zero and compress to nothing."""
    return (at & 0xFFFF).astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes()


def _unpack_at(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").astype(np.uint32).reshape(2, -1)
    return half[0] | half[1] << np.uint32(16)


def _deal(hashes, order, key, at, buckets: int, smaller: bool) -> pa.RecordBatch:
    """Rows for the buckets of a hash from one block. Only the entries of the block's smallest document of each hash are
    sent to be compared; what other documents of the block hold is already known to repeat. So a window that a third of
    all documents share is one document's entry a block. With ``smaller`` (level two) the smallest document's own fate stays
    open; without it (level one) a hash in two documents of the block is settled for all of them, and one entry, 48 bits of
    its hash, tells the other blocks."""
    s = np.lexsort((order, hashes))
    hashes, order, key, at = hashes[s], order[s], key[s], at[s]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    first = order == order[start][group]
    several = np.logical_or.reduceat(~first, start)[group] if len(start) else np.zeros(0, bool)
    mine = np.flatnonzero(first if smaller else first & (new | ~several))
    settled = np.flatnonzero(~first if smaller else several)
    bucket = (_mix(hashes[mine]) % np.uint64(buckets)).astype(np.int64)
    s = np.argsort(bucket, kind="stable")
    mine, cuts = mine[s], np.searchsorted(bucket[s], np.arange(buckets + 1))
    name = key.astype(np.int64) if smaller else (key & TAG).astype("<u4")
    rows = []
    for b in range(buckets):
        m, r = mine[cuts[b]:cuts[b + 1]], settled[b::buckets]        # settled entries only pass through: spread them evenly
        if len(m) or len(r):
            m = m[np.lexsort((at[m], key[m]))]                       # a document's entries side by side compress
            h = hashes[m].tobytes() if smaller else hashes[m].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((b, h, order[m].tobytes() if smaller else b"", name[m].tobytes(), _pack_at(at[m]), name[r].tobytes(), _pack_at(at[r])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()),
                                       *(pa.array([x[i] for x in rows], pa.binary()) for i in range(1, 7))],
                                      names=["bucket", "hash", "ord", "doc", "at", "sure_doc", "sure_at"])


def _settle(rows: DataFrame, smaller: bool, parts: int) -> DataFrame:
    """(key, found): per document the places whose hash is also in another block (level one, ``key`` a tag) or in a document
    of smaller order (``smaller``, level two).

    What a bucket finds is handed on in one row per part of the documents, and the parts gather the places of each document,
    so the rows between depend on the number of tasks, not on how many documents share how many windows."""
    name = "<i8" if smaller else "<u4"

    def run(key, t):
        cols = {c: t.column(c).to_pylist() for c in ("hash", "ord", "doc", "at", "sure_doc", "sure_at")}
        get = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in cols[c])])
        places = lambda c: np.concatenate([np.zeros(0, np.uint32), *map(_unpack_at, cols[c])])
        if smaller:
            h, o = get("hash", "<u8"), get("ord", "<i8")
        else:
            six = get("hash", np.uint8).reshape(-1, 6)
            h = np.pad(six, ((0, 0), (0, 2))).view("<u8").reshape(-1)
            o = np.repeat(np.arange(len(cols["hash"])), [len(x) // 6 for x in cols["hash"]])     # the block
        d, a = get("doc", name), places("at")
        s = np.lexsort((o, h))
        h, o, d, a = h[s], o[s], d[s], a[s]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        later = o != o[start][group] if len(h) else np.zeros(0, bool)
        hit = later if smaller else (np.logical_or.reduceat(later, start)[group] if len(start) else later)
        doc = np.r_[d[hit], get("sure_doc", name)].astype(name)
        at = np.r_[a[hit], places("sure_at")]
        part = (_mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        s = np.lexsort((at, doc, part))
        doc, at, cuts = doc[s], at[s], np.searchsorted(part[s], np.arange(parts + 1))
        spans = [(p, cuts[p], cuts[p + 1]) for p in range(parts) if cuts[p] < cuts[p + 1]]
        return pa.table({"part": pa.array([p for p, _, _ in spans], pa.int32()),
                         "doc": pa.array([doc[i:e].tobytes() for _, i, e in spans], pa.binary()),
                         "at": pa.array([_pack_at(at[i:e]) for _, i, e in spans], pa.binary())})

    def gather(key, t):
        doc = np.concatenate([np.zeros(0, name), *(np.frombuffer(x, name) for x in t.column("doc").to_pylist())]).astype(np.int64)
        at = np.concatenate([np.zeros(0, np.uint32), *map(_unpack_at, t.column("at").to_pylist())]).astype("<u4")
        s = np.lexsort((at, doc))
        doc, at = doc[s], at[s]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(doc)] if len(doc) else cut
        return pa.table({"key": pa.array(doc[cut], pa.int64()),
                         "found": pa.array([at[i:e].tobytes() for i, e in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())})

    found = rows.groupBy("bucket").applyInArrow(run, "part int, doc binary, at binary")
    return found.groupBy("part").applyInArrow(gather, "key long, found binary")


def _places(found) -> np.ndarray:
    return np.unique(np.frombuffer(found or b"", "<u4")).astype(np.int64)


def _pass(keyed: DataFrame, shared, through: bool) -> DataFrame:
    """Rows whose tag may be in the filter (``through``) or surely isn't."""
    def run(batches):
        for b in batches:
            maybe = np.zeros(b.num_rows, bool)
            tags = b.column("key").to_numpy(zero_copy_only=False) & TAG
            maybe[maybe_in(tags.astype(np.uint64), shared.value)] = True
            yield b.filter(pa.array(maybe if through else ~maybe))

    return keyed.mapInArrow(run, keyed.schema)


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     buckets: int | None = None):
    """(clear, some, found). ``clear``: the rows (id, ord, key, text) without any window that may repeat; ``some``: the others;
    ``found``: key, found: the places, as little-endian unsigned 32-bit integers, of the windows of a document that
    also start in a document of smaller id.

    Level one compares windows of half the length: of the seeds inside each whole window only the smallest, which equal
    windows have in common. Level two doubles those that occur in two documents to the whole length and compares again;
    documents without one drop out by a bounded filter, so their texts are never shuffled. ``buckets``: the tasks that
    hashes are dealt to, by default at least two per input partition, so a bucket stays small however large the input."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    keyed = df.select(F.col(id_col).alias("id"), order.alias("ord"), F.xxhash64(order, text).alias("key"), text.alias("text"))
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())

    def entries(rows, block, at, hashes, smaller):
        doc = np.searchsorted(block.start + block.n, at, side="right")
        own = rows.column("ord").to_numpy(zero_copy_only=False)[doc] if smaller else doc
        keys = rows.column("key").to_numpy(zero_copy_only=False)[doc]
        return _deal(hashes[at], own, keys, at - block.start[doc], n, smaller)

    def seeds(batches):
        for rows, texts in _blocks(batches, 3):
            block = Block(texts, window)
            yield entries(rows, block, np.flatnonzero(block.chosen), block.seeds, False)

    def wide(batches):
        for rows, texts in _blocks(batches, 3):
            block = Block(texts, window)
            at = block.candidates([_places(f) for f in rows.column("found").to_pylist()])
            yield entries(rows, block, at, block.wide, True)

    again = checkpoint(_settle(keyed.mapInArrow(seeds, ROWS), False, n))
    shared = key_filter(again.select("key"), again.count())
    path = scratch_path(spark, "repeats")                 # compressed, unlike a checkpoint
    tagged = _pass(keyed, shared, True).withColumn("tag", F.col("key").bitwiseAND(F.lit(TAG)))
    (tagged.join(again.withColumnRenamed("key", "tag"), "tag", "left").select("id", "ord", "key", "text", "found")
     .write.option("compression", "zstd").parquet(path))
    some = spark.read.parquet(path)
    found = _settle(some.where("found is not null").mapInArrow(wide, ROWS), True, n)
    return _pass(keyed, shared, False), some.drop("found"), found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   buckets: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept (the words left, joined by single spaces, as binary).

    Words are runs of characters other than space and U+0009 to U+000D. A word goes when a window of ``window`` words of
    its document that covers it also starts in a document of smaller id; all windows are judged on the input. Repeats
    inside one document, or among rows of the same id, stay. A null id is larger than any other. A null or empty text, or
    one shorter than the window, loses nothing. Extra columns are ignored; an empty table gives no rows."""
    clear, some, found = repeated_windows(df, id_col, text_col, window, buckets)
    cut = some.select("id", "key", "text").join(checkpoint(found), "key", "left").select("id", "text", "found")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            places = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for t, f in zip(b.column(1).cast(pa.binary()).to_pylist(), places, strict=True):
                words = (t or b"").split()
                n.append(len(words))
                if f:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = _places(f)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = list(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["id", "n_words", "n_removed", "kept"])

    schema = f"id {kind}, n_words long, n_removed long, kept binary"
    return clear.select("id", "text").mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
