"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A seed is the hash of ``q`` words of an item in order, with up to ``q - 1`` words left out between them; a document's seeds are
made alike. An alignment of m matches and e errors (substituted, inserted or deleted words) scores 2 m - e, so one that reaches
the threshold t of an item of n words has e <= 2 m - 2 t n. Take the matches in order, q at a time: their errors add up to at
most (q - 1) e, so at most (q - 1) e / q of the m - q + 1 groups hold q errors or more, and every other group is a seed on both
sides. ``seed_shape`` gives that number of shared seeds, ``least``, for each length; the seeds are therefore complete for the
threshold. Of the seeds of an item the most frequent go, as long as fewer than ``least`` are left out: any passage that
reaches the threshold still shares one of the rare ones."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, checkpoint, key_filter, maybe_in

SEED_WORDS = 4
SCORE = 0.5              # of the score of the whole item found unchanged
MATCH, MISS, GAP = 2, -1, -1
BITS_PER_SEED = 64       # of the broadcast seed filter; its size is bounded
BLOCK = 1 << 20          # bytes of text looked at together
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

# Words: letters in lower case; ASCII white space and punctuation part them.
_PART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PART).split()


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64)


def seed_shape(n_words: int, n: int = SEED_WORDS, threshold: float = SCORE) -> tuple[int, int, int]:
    """(q, gap, least) for an item: seeds of q words with at most gap words left out, of which a passage that reaches the
    threshold shares least or more. Items too short for gapped seeds of three words get n words in a row, or all they have."""
    for q in range(n, 2, -1):
        least = math.ceil(n_words * (2 - q + 2 * threshold * (q - 1)) / q - (q - 1) - 1e-9)
        if least >= 1:
            return q, q - 1, least
    return min(n, n_words), 0, 1


def gapped(each: np.ndarray, q: int, gap: int) -> list[tuple[int, np.ndarray]]:
    """(span, hashes) of all patterns of q words with at most gap words left out in all; hashes[i] starts at word i."""
    made = [(0, gap, each + np.uint64(q))]
    for _ in range(q - 1):
        made = [(last + 1 + skip, left - skip, h[:max(0, len(each) - last - 1 - skip)] * _FACTOR + each[last + 1 + skip:])
                for last, left, h in made for skip in range(left + 1)]
    return [(last + 1, h) for last, _, h in made]


def item_seeds(benchmark: DataFrame, n: int = SEED_WORDS, threshold: float = SCORE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words, n_words, q, gap, least (``seed_shape``), seeds (distinct hashes as longs, each with its number of places in
    the item). Rows without words are left out."""
    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            shapes = [seed_shape(len(w), n, threshold) for w in words]
            seeds = []
            for w, (q, gap, _) in zip(words, shapes, strict=True):
                found, times = np.unique(np.concatenate([h for _, h in gapped(_hashes(w), q, gap)]), return_counts=True) if w else ([], [])
                seeds.append([{"hash": h, "times": t} for h, t in zip(np.asarray(found, np.uint64).view(np.int64).tolist(), list(map(int, times)), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([b" ".join(w).decode(errors="replace") for w in words]), pa.array([len(w) for w in words], pa.int64()),
                 *(pa.array([s[i] for s in shapes], pa.int64()) for i in range(3)),
                 pa.array(seeds, pa.list_(pa.struct([("hash", pa.int64()), ("times", pa.int64())])))],
                names=["item", "words", "n_words", "q", "gap", "least", "seeds"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    return (benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t"))
            .mapInArrow(run, f"item {kind}, words string, n_words long, q long, gap long, least long, seeds array<struct<hash:long,times:long>>")
            .where("n_words > 0"))


def passages(docs: DataFrame, shared, reach: int, shapes: list[tuple[int, int]]) -> DataFrame:
    """``docs`` (id, key, text): one row per stretch of words around hits of seeds of any of the ``shapes`` (q, gap): id, key,
    start, words, hashes.

    A stretch covers ``reach`` words to either side of its hits; overlapping stretches are one."""
    def run(batches):
        table = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            ids, keys = b.column(0), b.column(1).to_pylist()
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= BLOCK or i == len(texts) - 1:
                    yield block(texts[first:i + 1], ids.slice(first, i + 1 - first), keys[first:i + 1], table)
                    first, size = i + 1, 0

    def block(texts, ids, keys, table):
        words = [words_of(t) for t in texts]
        count = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(count)
        each = _hashes(itertools.chain.from_iterable(words))
        hits = []
        for q, gap in shapes:
            for span, grams in gapped(each, q, gap):
                at = maybe_in(grams, table)
                at = at[at + span <= end[np.searchsorted(end, at, side="right")]]
                hits.append((at, at + span, grams[at]))
        at, to, seed = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(at, kind="stable")
        at, to, seed = at[order], to[order], seed[order]
        doc = np.searchsorted(end, at, side="right")
        begin = (end - count)[doc]
        out = []
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > 2 * reach)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True) if len(at) else ():
            d, w0 = int(doc[i]), int(begin[i])
            lo, hi = max(0, int(at[i]) - w0 - reach), int(to[i:j].max()) - w0 + reach
            out.append((d, keys[d], lo, b" ".join(words[d][lo:hi]).decode(errors="replace"),
                        np.unique(seed[i:j]).view(np.int64).tolist()))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string()),
             pa.array([o[4] for o in out], pa.list_(pa.int64()))], names=["id", "key", "start", "words", "hashes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "text").mapInArrow(run, f"id {kind}, key long, start long, words string, hashes array<long>")


def seed_pairs(hits: DataFrame, items: DataFrame) -> DataFrame:
    """passage, ref of every (passage, item) that can reach the item's threshold. ``hits``: passage, hash, distinct rows.

    The seeds of an item are ordered by their number of passages, the frequent ones first; those whose places add up to
    fewer than ``least`` start nothing, and a pair must share as many of the others as are then needed."""
    seeds = items.select("ref", "least", F.explode("seeds").alias("s")).select("ref", "least", "s.hash", "s.times")
    often = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    up_to = Window.partitionBy("ref").orderBy(F.desc("often"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    rare = seeds.join(often, "hash").withColumn("sum", F.sum("times").over(up_to))
    dropped = F.max(F.when(F.col("sum") < F.col("least"), F.col("sum"))).over(Window.partitionBy("ref"))
    rare = rare.withColumn("need", F.col("least") - F.coalesce(dropped, F.lit(0))).where("sum >= least")
    return (hits.join(rare.select("hash", "ref", "times", "need"), "hash").groupBy("passage", "ref")
            .agg(F.sum("times").alias("sum"), F.first("need").alias("need")).where("sum >= need").select("passage", "ref"))


def align(item: list, passage: list) -> tuple[int, int, int]:
    """Smith-Waterman over words: (score, first, end) of the best local alignment, as places in ``passage``."""
    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        row = np.zeros(len(b) + 1, np.int64)
        ramp = -GAP * np.arange(len(b) + 1)
        top, at = 0, 0
        for w in a:
            new = np.maximum(row + GAP, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == w, MATCH, MISS))
            row = np.maximum.accumulate(new + ramp) - ramp
            k = int(row.argmax())
            if row[k] > top:
                top, at = int(row[k]), k
        return top, at

    ids: dict = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item], np.int64)
    b = np.array([ids.setdefault(w, len(ids)) for w in passage], np.int64)
    score, end = best(a, b)
    _, back = best(a[::-1], b[:end][::-1])
    return score, end - back, end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = SCORE, n: int = SEED_WORDS) -> DataFrame:
    """One row per (row of ``docs``, benchmark item) whose best alignment scores ``threshold`` of the whole item or more:
    id, key, item, score, first_word, end_word (places among the document's words).

    Seeds are groups of ``n`` words of an item with gaps (see the module); of an item of 7 to 12 words groups of three. At the
    threshold 0.5 they are complete: every passage that reaches it shares one. Of an item of 4 to 6 words, four words in a row
    must stand unchanged, of a shorter one all its words. A pair that shares enough seeds is aligned unless the passage has too
    few of the item's words to reach the threshold in any order. Equal passages are aligned once. A document found several
    times for an item is reported with its best passage.
    Null or empty texts match nothing; rows that repeat an id are told apart by their text; equal rows are reported once. Items repeated under one item_id count as one item each. Empty tables give
    no rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    items = checkpoint(item_seeds(benchmark, n, threshold).withColumn("ref", F.xxhash64("item", "words")).dropDuplicates(["ref"]))
    distinct = items.select(F.explode("seeds.hash").alias("hash")).distinct()
    size = items.agg(F.max("n_words"), F.sum(F.size("seeds"))).first()
    reach = math.ceil((3 - 2 * threshold) * (size[0] or 0)) + 8       # words of the longest passage that reaches the threshold
    shared = key_filter(distinct, size[1] or 0, BITS_PER_SEED)
    shapes = sorted(tuple(r) for r in items.select("q", "gap").distinct().collect()) or [(n, 0)]     # at most 2 n
    found = checkpoint(passages(keyed, shared, reach, shapes).withColumn("passage", F.xxhash64("words")))
    texts = checkpoint(found.select("passage", "words", "hashes").dropDuplicates(["passage"]))   # equal words have equal hits
    pairs = checkpoint(seed_pairs(checkpoint(texts.select("passage", F.explode("hashes").alias("hash")).join(distinct, "hash", "left_semi")), items))
    both = (pairs.join(texts.select("passage", "words"), "passage")
            .join(items.select("ref", "item", F.col("words").alias("item_words")), "ref")
            .select("passage", "item", "ref", "words", "item_words"))

    def run(batches):
        for b in batches:
            got = []
            for i, (passage, item) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4)), strict=True)):
                want, have = item.split(" "), passage.split(" ")
                least = threshold * MATCH * len(want)
                if MATCH * (Counter(want) & Counter(have)).total() < least:   # no alignment scores more than its matches
                    continue
                s, first, end = align(want, have)
                if s >= least:
                    got.append((i, s / (MATCH * len(want)), first, end))
            rows = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(rows) for c in range(3)), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                names=["passage", "item", "ref", "score", "first", "end"])

    kind = items.schema["item"].dataType.simpleString()
    scored = checkpoint(both.mapInArrow(run, f"passage long, item {kind}, ref long, score double, first long, end long"))
    best = F.max(F.struct("score", (-F.col("start") - F.col("first")).alias("neg"), (F.col("start") + F.col("end")).alias("end_word"),
                          "id", "item")).alias("b")
    return (found.select("id", "key", "start", "passage").join(scored, "passage").groupBy("key", "ref").agg(best)
            .select("b.id", "key", "b.item", "b.score", (-F.col("b.neg")).alias("first_word"), "b.end_word"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of each document that holds a benchmark item."""
    return contaminated(docs, benchmark).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "first_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item. Columns may have any names."""
    return by_place(docs, [id_col, text_col], lambda d, i, t: _drop_contaminated(d, benchmark, i, t))


def _drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bad = checkpoint(contaminated(docs, benchmark, id_col, text_col).select(F.col("key").alias("__key")).distinct())
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumn("__own", key).join(bad, F.col("__own") == F.col("__key"), "left_anti").drop("__own")
