"""SimHash near-dedup with bit-sliced comparison of fingerprints."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_place, checkpoint

SHINGLE = 4
RADIUS = 4
SEED = 42
PARTS = 6                # the 64 bits in 6 parts: fingerprints within 4 bits agree in 2 parts at least
CHUNK = 4096             # fingerprints of a bucket that one side of a comparison holds
ROWS = 1 << 17           # fingerprints a task compares at a time
PAIRS = 1 << 14          # (fingerprint, word of 64 others) comparisons in flight


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """8 bytes, most significant first; zero when there is no word."""
    words = text.lower().split()                    # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        h = b"".join([digest(joined[a:e - 1], SEED)
                      for a, e in zip(starts[at:min(n, at + (1 << 16))], ends[at + shingle - 1:], strict=False)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the 64-bit fingerprint of the whole text as a signed long; null counts as empty."""
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.string()).cast(pa.binary()).to_pylist()
            fp = np.frombuffer(b"".join(fingerprint(t or b"", shingle) for t in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType(df.schema.fields + [StructField(out, LongType())]))


def _part_keys(radius: int) -> list[tuple[int, int]]:
    """(mask) pairs of parts; any two fingerprints within ``radius`` agree under at least one mask."""
    agree = PARTS - radius                          # parts that must agree
    edges = [round(i * 64 / PARTS) for i in range(PARTS + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(PARTS)]
    return [sum(c) for c in itertools.combinations(masks, max(1, agree))]


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    pad = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    pad[:len(fp)] = fp
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")     # (rows, 64)
    return np.packbits(bits.T.reshape(64, -1, 64), axis=2, bitorder="little").reshape(64, -1, 8).copy().view("<u8")[:, :, 0]


def _span(lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits of ``word`` whose rows are in lo..hi-1."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    a = np.clip(lo - word * 64, 0, 64)
    e = np.clip(hi - word * 64, 0, 64)
    below = lambda k: np.where(k >= 64, full, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    return below(e) & ~below(a)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-row label of each row after joining a[i] with b[i]."""
    while len(a):
        la, lb = label[a], label[b]
        move = la != lb
        if not move.any():
            break
        a, b, la, lb = a[move], b[move], la[move], lb[move]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def compare(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> np.ndarray:
    """Labels (smallest row reached) after linking each row to those of rows lo[i]..hi[i]-1 within ``radius`` bits.

    The 64 rows of a word are compared with a row at once: each plane is XORed with the row's bit and added to
    carry-save counters of the 64 distances. A word is dropped as soon as all its distances exceed the radius."""
    planes, label = _planes(fp), np.arange(len(fp))
    first, last = lo // 64, np.where(hi > lo, (hi - 1) // 64 + 1, lo // 64)
    rows = np.flatnonzero(last > first)
    count = (last - first)[rows]
    ends = np.cumsum(count)
    levels = (radius + 1).bit_length()
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        k = np.arange(at, min(at + PAIRS, int(ends[-1])))
        r = np.searchsorted(ends, k, side="right")
        q = rows[r]
        w = first[q] + (k - (ends[r] - count[r]))
        dead = ~_span(lo[q], hi[q], w)              # rows outside the range, later also those too far
        counter = [np.zeros(len(q), np.uint64) for _ in range(levels)]
        mine = fp[q]
        for b in range(64):
            d = planes[b, w] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
            for i in range(levels):
                carry = counter[i] & d
                counter[i] ^= d
                d = carry
            dead |= d | _above(counter, radius)     # past the top counter, or over the radius
            if b % 8 == 7:
                live = dead != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    q, w, dead, mine = q[live], w[live], dead[live], mine[live]
                    counter = [c[live] for c in counter]
                    if not len(q):
                        break
        if len(q):
            near = np.unpackbits((~dead).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            label = _roots(label, q[i], w[i] * 64 + j)
    return label


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counters stand above ``radius``: a bitwise comparison from the top counter down."""
    above, equal = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            above = above | (equal & counter[i])
            equal = equal & ~counter[i]
    return above


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints ``fp``; b < a.

    Each fingerprint goes to one bucket per pair of parts. Buckets over ``chunk`` fingerprints are cut into chunks
    and every two chunks meet in a task of their own, so no bucket is gathered whole. A task returns one link per
    fingerprint, to the smallest it is connected with there, never all pairs."""
    masks = _part_keys(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("k")
    ).select("k.t", "k.key", "fp")
    sizes = checkpoint(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    cut = keys.join(sizes, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    cut = (cut.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .select("t", "key", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "c", "fp"))

    def run(batches):
        def flush(parts):
            t, key, lo, hi, c, fp = (np.concatenate([p[i] for p in parts]) for i in range(6))
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            start = np.flatnonzero(new)
            end = np.r_[start[1:], len(fp)]
            n = end - start
            stop, row = np.repeat(end, n), np.arange(len(fp))
            # In a bucket of two chunks (sorted by chunk) the first is compared with the second only.
            second = np.repeat(np.add.reduceat((c == lo).astype(np.int64), start) + start, n)
            mixed = lo != hi
            a = np.where(mixed, second, row + 1)
            e = np.where(mixed & (c == hi), a, stop)
            u = fp.view(np.uint64)
            label = compare(u, a, np.maximum(a, e), radius)
            some = np.flatnonzero(label != row)
            x, y = fp[some], fp[label[some]]
            pairs = np.unique(np.c_[np.maximum(x, y), np.minimum(x, y)], axis=0) if len(some) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            n += b.num_rows
            if n >= ROWS:                            # up to the last bucket's start
                cols = [np.concatenate([p[i] for p in held]) for i in range(6)]
                same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]) & (cols[3] == cols[3][-1])
                cutoff = n - int(same.sum())
                if cutoff:
                    yield flush([[x[:cutoff] for x in cols]])
                held, n = [[x[cutoff:] for x in cols]], n - cutoff
        if n:
            yield flush(held)

    dealt = cut.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "c", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, root) for all nodes with a link: root is the smallest node reachable. Alternating star contraction:
    each round every node hands its larger neighbours, then its smaller ones, to the smallest it knows; ends when
    the links no longer change, after about log rounds; raises if ``limit`` rounds don't suffice. Only joins and
    partial minima."""
    e = checkpoint(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(e)
    for turn in itertools.count():
        if turn == limit:
            raise RuntimeError(f"components still change after {limit} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u <> v").distinct())             # u > v
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        e = checkpoint(small.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("w").alias("u"), "v"))).alias("x"))
                       .select("x.u", "x.v").where("u <> v").distinct())
        after = sign(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: id, row (hash of the text), fp, component_id, lead (struct of id and row of the document
    that stands for the group).

    Documents are linked when their fingerprints differ in at most ``radius`` bits; groups are connected components.
    ``component_id`` is the smallest id of the group (null only if all are). Null and empty texts have fingerprint zero
    and are linked like any other. Repeated rows get the same values. Copies share a fingerprint, so only distinct
    fingerprints are compared and joined. Extra columns are ignored; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), text.alias("__t"))
    own = checkpoint(with_fingerprint(own.withColumn("row", F.xxhash64("__t")), "__t", "fp", shingle).drop("__t"))
    prints = checkpoint(own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("lead")))
    comp = components(links(prints.select("fp"), radius))
    rooted = checkpoint(prints.join(comp, F.col("fp") == F.col("node"), "left")
                        .select("fp", "lead", F.coalesce("root", "fp").alias("root")))
    lead = checkpoint(rooted.groupBy("root").agg(F.min("lead").alias("lead")))
    labelled = checkpoint(rooted.select("fp", "root").join(lead, "root").select("fp", "lead"))
    return own.join(labelled, "fp").select("id", "row", "fp", F.col("lead.id").alias("component_id"),
                                           F.struct("lead.id", "lead.row").alias("lead"))


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with one row per near-duplicate group: that of the smallest id (null ids last, then
    the smaller text hash); rows alike in id and text collapse to the largest in all columns. Columns may have any names."""
    return by_place(df, [id_col, text_col], _keep_one)


def _keep_one(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    groups = near_groups(df, id_col, text_col)
    same = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("row") == F.col("lead.row"))
    leads = checkpoint(groups.where(same).groupBy(F.col("id").alias("__id"), F.col("row").alias("__row"))
                       .agg(F.count("*").alias("__n")))
    kept = (df.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
            .join(leads, (F.col("__own") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id"))))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    alone = kept.where("__n = 1").select(*[F.col(f"`{c}`") for c in df.columns])
    repeated = kept.where("__n > 1").groupBy("__own", "__id").agg(F.max(row).alias("__r")).select("__r.*")
    return alone.unionByName(repeated)
