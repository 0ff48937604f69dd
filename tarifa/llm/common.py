"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.session import checkpoint, ensure_checkpoint_dir

__all__ = ["by_place", "checkpoint", "key_filter", "maybe_in", "prefix_sum", "scratch_path", "smallest", "table"]

MAX_FILTER_BITS = 1 << 27   # proven bound of a broadcast key filter: 16 MB
PROBES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def by_place(df: DataFrame, cols: list[str], run, added: tuple = ()) -> DataFrame:
    """``run`` on ``df`` with its columns named c0, c1, .. and the new names of ``cols``, so that no column of the input, whatever its
    name, meets one of the operator's own. ``run`` returns those columns in order and then ``added``; the input's names
    return, and an added name that the input has already gets underscores until it is new."""
    names, new = df.columns, []
    out = run(df.toDF(*[f"c{i}" for i in range(len(names))]), *[f"c{names.index(c)}" for c in cols])
    for name in added:
        while name in [*names, *new]:
            name += "_"
        new.append(name)
    return out.toDF(*names, *new)


def prefix_sum(df: DataFrame, keys: list[str], value: str | None, order: list[str], out: str,
               buckets: int = 4096, first: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` (1 when None) over the rows of the same ``keys`` that come
    earlier. The order is by a hash bucket of ``order``, then by ``order``, so no key is sorted in one
    task: a window only ever sees one bucket of one key, and the bucket totals (at most ``buckets``
    rows a key and class) give each bucket its offset. ``first``: a class (0, 1, ..) that goes before all else."""
    val = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    d = df.withColumn("__v", val).withColumn("__b", bucket if first is None else first.cast("int") * buckets + bucket)
    by_key = Window.partitionBy(*keys).orderBy("__b") if keys else Window.partitionBy(F.lit(0)).orderBy("__b")
    off = (d.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
           .withColumn("__o", F.sum("__t").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")))
    cond = F.lit(True)
    o = off.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__ob"), "__o")
    for k in keys:
        cond = cond & d[k].eqNullSafe(F.col(f"__k_{k}"))
    d = d.join(o, cond & (F.col("__b") == F.col("__ob")), "inner")
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(out, F.col("__o") + F.sum("__v").over(inside) - F.col("__v"))
    return d.drop("__v", "__b", "__ob", "__o", *[f"__k_{k}" for k in keys])


def smallest(df: DataFrame, col: str, limit: int) -> DataFrame:
    """Rows whose long ``col`` is at most the ``limit``-th smallest of all rows (ties of the last one stay; none is null).

    That value is found by counting 2^16 runs of the leading bits, then those of the run that holds it, and so on: four passes
    over the one column, each with at most 2^16 rows to the driver, so no task merges the rows of the others."""
    u, lead, want = F.col(col).bitwiseXOR(F.lit(-1 << 63)), 0, limit          # in order as unsigned
    for shift in (48, 32, 16, 0):
        d = df if shift == 48 else df.where(F.shiftrightunsigned(u, shift + 16) == lead)
        counts = sorted((r["b"], r["n"]) for r in d.groupBy(F.shiftrightunsigned(u, shift).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("b"))
                        .agg(F.count("*").alias("n")).collect())
        if shift == 48 and sum(n for _, n in counts) <= limit:
            return df
        for b, n in counts:
            if n >= want:
                lead = lead << 16 | b
                break
            want -= n
    return df.where(F.col(col) <= F.lit(lead - (1 << 63)))


def key_filter(keys: DataFrame, count: int, bits_per_key: int = 16, max_bits: int = MAX_FILTER_BITS):
    """A broadcast Bloom filter of the one long column of ``keys``: no false negatives, at most ``max_bits`` bits; with more
    than ``max_bits / bits_per_key`` keys it rules out less, and what it lets through still has to be joined. The slots
    (key + i * step) mod bits are set by an aggregation, so the driver receives the bits only."""
    bits = int(min(max_bits, max(1 << 16, 1 << (bits_per_key * max(count, 1) - 1).bit_length())))
    key, low = F.col(keys.columns[0]), lambda c: c.bitwiseAND(F.lit(bits - 1).cast("long"))
    step = F.shiftrightunsigned(key, 20).bitwiseOR(F.lit(1).cast("long"))
    slots = F.explode(F.array(*[low(low(key) + F.lit(i) * low(step)) for i in range(PROBES)]))
    words = (keys.select(slots.alias("s")).groupBy(F.shiftright("s", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("b")))
    table = np.zeros(bits // 8, np.uint8)
    view = table.view("<u4")
    for r in words.toLocalIterator():
        view[r["w"]] = r["b"]
    return keys.sparkSession.sparkContext.broadcast(table)


def maybe_in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the keys (unsigned 64-bit) that the filter does not rule out."""
    at, low = np.arange(len(keys)), np.uint64(len(bits) * 8 - 1)
    for i in range(PROBES):
        h = keys[at]
        p = ((h + np.uint64(i) * ((h >> np.uint64(20)) | np.uint64(1))) & low).astype(np.int64)
        at = at[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
    return at
