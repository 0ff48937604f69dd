"""Spelling variants: words one edit apart, found by pivotal grams (two disjoint rare bigrams of each word).

Bigrams are ordered by the number of words that hold them, rarest first. The prefix of a word is its three rarest
bigrams with all that tie with the third; its pivots are two bigrams of the prefix that share no letter, chosen by
dynamic programming so that their frequencies sum to the least. One edit destroys at most one of two disjoint
bigrams, so of two near words, the one whose prefix ends earlier in the order (either one on a tie) has a pivot that
stands in the other's prefix. As the edit lies wholly before or wholly after that bigram, the bigram keeps its distance
to the front and all letters there, or its distance to the end and all letters there. That is the position limit; it
is part of the join key, so only words that agree on one side of a rare bigram meet, and each meeting is verified. Where
that side has few letters, the other one is halved: the edit leaves one of its halves, and the key takes that in too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MIN_LENGTH = 5      # code points of a word; three bigrams (four code points) are the least that the method can do with
MIN_COUNT = 3
RATIO = 2           # a form is at least so many times as frequent
SLIP = 97
KNOWN = 5           # letters of a word that a join key without halves has at least
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
_PORTION = 1 << 20  # code points of a text that are cut into words at a time
_HELD = 200_000     # distinct words a task counts before it hands its counts on


def _runs(text: str):
    """Lists of the letter runs of ``text``, portion by portion; no run is cut."""
    at = 0
    while at < len(text):
        end = at + _PORTION
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _text_counts(doc_id, text: str, min_length: int, slip: int | None) -> Counter:
    """Occurrences of the words of one text, after deletions."""
    own = Counter()
    for runs in _runs(text):
        own.update(runs)
    out, base = Counter(), zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for w, c in own.items():
        if len(w) < min_length:
            continue
        if slip:
            h = zlib.crc32(w.encode(), base)
            if h % slip == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
                if len(w) < min_length:
                    continue
        out[w] += c
    return out


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, slip: int | None = None) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF in the whole texts, A-Z lower-cased, of at least ``min_length``
    code points and ``min_count`` occurrences. Null and empty texts hold none. With ``slip``, a run whose checksum
    crc32("<id>:<run>") is divisible by ``slip`` loses the code point at checksum mod length first (a null id is written
    as nothing). Each task adds up its words before they are shuffled."""
    def count(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t:
                    held.update(_text_counts(i, t.lower().decode("utf-8", "replace"), min_length, slip))   # bytes.lower(): A-Z only
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def pivots(prefix: list, want: int = 2) -> list:
    """``want`` bigrams of ``prefix`` (position, frequency, ..) that share no letter, with the least sum of frequencies. By dynamic
    programming over the positions: best[j] after a place holds the cheapest j disjoint bigrams that end before it."""
    prefix = sorted(prefix)
    nothing = (float("inf"), ())
    best = [[(0, ())] + [nothing] * want]               # best[i][j]: j bigrams out of the first i
    for i, g in enumerate(prefix):
        free = i
        while free and prefix[free - 1][0] > g[0] - 2:  # the bigrams before `free` end before this one starts
            free -= 1
        row = list(best[i])
        for j in range(1, want + 1):
            cost, chosen = best[free][j - 1]
            if cost + g[1] < row[j][0]:
                row[j] = (cost + g[1], (*chosen, g))
        best.append(row)
    return list(best[-1][want][1])


def _keys(word: str, p: int, lengths) -> list:
    """Join keys of the bigram at ``p``. ``lengths``: those that the word whose pivot it is may have; where a key needs halves, they
    are those of that word, the places before and after the bigram being counted from the front or from the end."""
    n, out = len(word), []
    if p + 2 >= KNOWN:                                          # edit after the bigram, all before it known
        out.append("<" + word[:p + 2])
    else:
        for m in lengths:
            tail = m - p - 2 - (half := (m - p - 2) // 2)
            if n >= p + 2 + half:                               # edit in the second half
                out.append(f"{m}<" + word[:p + 2 + half])
            if n >= p + 2 + tail:                               # edit in the first half
                out.append(f"{m}=" + word[:p + 2] + "|" + word[n - tail:])
    if n - p >= KNOWN:                                          # edit before the bigram, all after it known
        out.append(">" + word[p:])
    else:
        for m in lengths:
            half = (m - n + p) // 2
            if m - n + p >= 0 and n >= m - half:                # edit in the first half
                out.append(f"{m}>" + word[n - m + half:])
            if 0 <= half <= p:                                  # edit in the second half
                out.append(f"{m}~" + word[:half] + "|" + word[p:])
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct words of ``words`` (columns word, n; at least four code points each, no word
    twice) that differ by exactly one inserted, deleted or replaced code point.

    The order of the bigrams is a broadcast table with one row per bigram in use; letters are a fixed set of 90, so it
    has at most 8 100 rows for words of ``word_counts``."""
    spark = words.sparkSession
    grams = (words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))"))).alias("g"))
             .groupBy("g").agg(F.count("*").alias("f")).collect())
    order = {r["g"]: (i, r["f"]) for i, r in enumerate(sorted(grams, key=lambda r: (r["f"], r["g"])))}
    shared = spark.sparkContext.broadcast(order)

    def cut(batches):
        rank = shared.value
        for b in batches:
            out = [[], [], [], []]
            for w in b.column(0).to_pylist():
                n = len(w)
                all_ = [(p, rank[w[p:p + 2]][1], rank[w[p:p + 2]][0]) for p in range(n - 1)]
                last = sorted(x[2] for x in all_)[2]
                prefix = [x for x in all_ if x[2] <= last]
                for pivot, chosen, lengths in ((True, pivots(prefix), (n,)), (False, prefix, (n - 1, n, n + 1))):
                    keys = {k for g in chosen for k in _keys(w, g[0], lengths)}
                    out[0] += [pivot] * len(keys)
                    out[1] += keys
                    out[2] += [w] * len(keys)
                    out[3] += [last] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.bool_(), pa.string(), pa.string(), pa.int32()), strict=True)],
                                             names=["pivot", "key", "word", "last"])

    cuts = words.select("word").mapInArrow(cut, "pivot boolean, key string, word string, last int").withColumn("key", F.xxhash64("key"))
    cuts = checkpoint(cuts)       # a hash of the key is enough, as what meets is verified
    r = cuts.where("pivot").select("key", F.col("word").alias("a"), F.col("last").alias("a_last"))
    s = cuts.where("not pivot").select("key", F.col("word").alias("b"), F.col("last").alias("b_last"))
    limits = (F.col("a_last") <= F.col("b_last")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b"))
    met = r.join(s, "key").where(limits).where(F.levenshtein("a", "b", 1) == 1)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last. A form is more frequent than its word, so there
    is no circle; each round doubles the steps taken."""
    at = checkpoint(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while at.where("moved").limit(1).count():
        on = at.select(F.col("word").alias("w"), F.col("root").alias("r"))
        at = checkpoint(at.select("word", "root").join(on, F.col("root") == F.col("w"), "left")
                        .select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
    return at.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: first in code-point order) if it
    is at least ``ratio`` (more than 1) times as frequent as the word, else null; ``root`` is the word reached by following
    forms, the word itself if it has none. No rows for an empty table."""
    if ratio <= 1:
        raise ValueError("ratio must be more than 1")
    words = checkpoint(words.select("word", "n"))
    pairs = checkpoint(near_words(words))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    own = words.join(best, "word", "left")
    enough = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    own = checkpoint(own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    return (own.join(_roots(own.where("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def document_variants(docs: DataFrame) -> DataFrame:
    """Variant groups of the words of ``documents``, a few of them with a letter deleted as ``slip`` says."""
    return variant_groups(word_counts(docs, slip=SLIP))
