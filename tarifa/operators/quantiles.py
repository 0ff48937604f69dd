"""Exact quantiles of a whole column without gathering the column in one task.

Spark's exact ``percentile``/``median`` merges a value→count map of every distinct value
into a single task for a global aggregate. Here each pass is a bounded aggregation:

1. one pass: n, min, max;
2. the target ranks r_lo = ⌊q(n−1)⌋ and r_hi = ⌈q(n−1)⌉ are located by an equal-width
   histogram of ``bins`` buckets over the current bracket (one groupBy, ≤ bins rows);
   the bracket shrinks to the buckets holding the two ranks;
3. when a bracket holds at most ``collect_limit`` values (or a single distinct value), those
   values — a bounded set — are taken to the driver and the ranks read off exactly.

The result is the linear interpolation v[r_lo] + (v[r_hi] − v[r_lo])·(q(n−1) − r_lo), the
same definition as Spark's ``percentile`` and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt


def _kth(df: DataFrame, col: str, k: int, lo: float, hi: float, below: int, count: int,
         bins: int, collect_limit: int):
    """The k-th smallest (0-based) value of ``col``, knowing that the ``count`` values in
    [lo, hi] hold ranks below … below + count − 1. Bucketing by floor((v − lo)/width) is
    monotone in v, so each bucket is a contiguous run of the sorted values and its own
    min / max bound exactly its values."""
    for edge in (-math.inf, math.inf):            # infinities have no place in an equal-width histogram
        if edge in (lo, hi):
            at = df.filter((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))
            st = at.agg(F.count_if(F.col(col) == F.lit(edge)).alias("e"), F.min(F.when(F.col(col) > F.lit(-math.inf), F.col(col))).alias("mn"),
                        F.max(F.when(F.col(col) < F.lit(math.inf), F.col(col))).alias("mx")).first()
            if edge < 0:
                if k - below < st["e"]:
                    return edge
                lo, below = st["mn"], below + st["e"]
            else:
                if k - below >= count - st["e"]:
                    return edge
                hi = st["mx"]
            count -= st["e"]
    while True:
        if lo == hi:
            return lo
        inb = df.filter((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))
        if count <= collect_limit:
            vals = sorted(r[0] for r in inb.select(col).collect())
            return vals[k - below]
        width = hi / bins - lo / bins             # not (hi - lo) / bins, which may overflow
        b = F.least(F.floor(F.col(col) / F.lit(width) - F.lit(lo) / F.lit(width)).cast("long"), F.lit(bins - 1)) if width > 0 else F.col(col)
        hist = sorted(tuple(r) for r in inb.groupBy(b.alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min(col).alias("mn"), F.max(col).alias("mx")).collect())
        acc, before = below, (lo, hi, count)
        for _, c, mn, mx in hist:
            if acc + c > k:
                lo, hi, below, count = mn, mx, acc, c
                break
            acc += c
        if (lo, hi, count) == before:             # neighbouring floats: split by value
            for v, c in sorted(tuple(r) for r in inb.groupBy(col).agg(F.count(F.lit(1))).collect()):
                if acc + c > k:
                    return v
                acc += c


def exact_quantiles(df: DataFrame, col: str, qs, bins: int = 4096, collect_limit: int = 100_000) -> dict:
    """{q: exact interpolated quantile} of the non-NULL values of ``col``."""
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    st = d.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    n = st["n"]
    out = {}
    if n == 0:
        return {q: None for q in qs}
    cache = {}
    for q in qs:
        pos = q * (n - 1)
        r_lo, r_hi = int(math.floor(pos)), int(math.ceil(pos))
        for r in (r_lo, r_hi):
            if r not in cache:
                cache[r] = _kth(d, "v", r, st["mn"], st["mx"], 0, n, bins, collect_limit)
        lo_v, hi_v = cache[r_lo], cache[r_hi]
        out[q] = lo_v if lo_v == hi_v or pos == r_lo else lo_v + (hi_v - lo_v) * (pos - r_lo)
    d.unpersist()
    return out


class _Bracket:
    """Values of one column in [lo, hi], ``count`` of them, ``below`` smaller ones; ``ranks`` fall inside."""

    def __init__(self, col: int, lo: float, hi: float, below: int, count: int, ranks: list):
        self.col, self.lo, self.hi, self.below, self.count, self.ranks = col, lo, hi, below, count, ranks
        self.stuck = False

    def split(self, runs) -> list:
        """The brackets among ``runs`` (count, smallest, largest; ascending) that hold a rank."""
        out, acc = [], self.below
        for c, mn, mx in runs:
            inside = [r for r in self.ranks if acc <= r < acc + c]
            if inside:
                out.append(_Bracket(self.col, mn, mx, acc, c, inside))
            acc += c
        return out


def _refine(d: DataFrame, names: list, open_: list, bucket) -> dict:
    """{bracket: [(count, smallest, largest), ..] ascending} of all brackets by one aggregation: a row is counted in the
    bucket (``bucket(value, bracket)``) of each bracket that its values fall in."""
    hits = [F.when((F.col(names[b.col]) >= F.lit(b.lo)) & (F.col(names[b.col]) <= F.lit(b.hi)),
                   F.struct(F.lit(i).alias("i"), bucket(F.col(names[b.col]), b).cast("double").alias("b"),
                            F.col(names[b.col]).alias("v"))) for i, b in enumerate(open_)]
    found = (d.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.i", "h.b")
             .agg(F.count(F.lit(1)).alias("c"), F.min("h.v").alias("mn"), F.max("h.v").alias("mx")).collect())
    runs: dict = {}
    for r in sorted(found, key=lambda r: (r["i"], r["b"])):
        runs.setdefault(r["i"], []).append((r["c"], r["mn"], r["mx"]))
    return runs


def column_quantiles(df: DataFrame, wanted: dict, bins: int = 4096, collect_limit: int = 100_000) -> dict:
    """{column: {q: exact interpolated quantile}} for ``wanted`` {column: [q, ..]}, all columns in the same passes.

    One aggregation counts every column; each further one refines the open brackets of all columns at once, so the number of
    passes is that of the slowest column, not the sum. NULL and NaN don't count; infinities do; a column without values
    gives None. The driver receives at most ``bins`` rows a bracket in a pass, fewer when many are open, and at most
    ``collect_limit`` values in all once brackets are small."""
    cols = list(wanted)
    names = [f"v{i}" for i in range(len(cols))]
    if not cols:
        return {}
    value = [F.col(f"`{c}`").cast("double") for c in cols]
    d = df.select(*[F.when(~F.isnan(v), v).alias(n) for v, n in zip(value, names, strict=True)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        inf = F.lit(math.inf)
        stats = d.agg(*[e.alias(f"{n}_{k}") for n in names for k, e in (
            ("n", F.count(n)), ("low", F.count_if(F.col(n) == -inf)), ("high", F.count_if(F.col(n) == inf)),
            ("mn", F.min(F.when(F.abs(n) < inf, F.col(n)))), ("mx", F.max(F.when(F.abs(n) < inf, F.col(n)))))]).first()
        open_, at = [], {}
        for i, c in enumerate(cols):
            n, low, high = (stats[f"{names[i]}_{k}"] for k in ("n", "low", "high"))
            ranks = {r for q in wanted[c] for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))} if n else set()
            at |= {(i, r): -math.inf if r < low else math.inf for r in ranks if r < low or r >= n - high}
            inside = sorted(r for r in ranks if low <= r < n - high)
            if inside:
                open_.append(_Bracket(i, stats[f"{names[i]}_mn"], stats[f"{names[i]}_mx"], low, n - low - high, inside))
        while True:
            at |= {(b.col, r): b.lo for b in open_ if b.lo == b.hi for r in b.ranks}
            open_ = [b for b in open_ if b.lo < b.hi]
            if not open_:
                break
            room = collect_limit // len(open_)
            width = max(16, min(bins, 16 * bins // len(open_)))

            def bucket(v, b, room=room, width=width):
                step = b.hi / width - b.lo / width        # not (hi - lo) / width, which may overflow
                if b.count <= room or b.stuck or step == 0:
                    return v                              # each value by itself
                return F.least(F.floor(v / F.lit(step) - F.lit(b.lo) / F.lit(step)), F.lit(width - 1))

            runs = _refine(d, names, open_, bucket)
            parts = []
            for i, b in enumerate(open_):
                new = b.split(runs[i])
                for x in new:
                    x.stuck = (x.lo, x.hi) == (b.lo, b.hi)     # neighbouring floats share a bucket: by value next
                parts += new
            open_ = parts
    finally:
        d.unpersist()
    out: dict = {}
    for i, c in enumerate(cols):
        n = stats[f"{names[i]}_n"]
        out[c] = {}
        for q in wanted[c]:
            if not n:
                out[c][q] = None
                continue
            pos = q * (n - 1)
            lo, hi = at[i, math.floor(pos)], at[i, math.ceil(pos)]
            out[c][q] = lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))
    return out


def exact_median_values(df: DataFrame, cols, **kw) -> dict:
    """{column: exact median}, all columns in the same passes."""
    return {c: v[0.5] for c, v in column_quantiles(df, {c: [0.5] for c in cols}, **kw).items()}


def exact_medians(df: DataFrame, cols, **kw) -> DataFrame:
    """A4 at scale: one-row table of exact medians."""
    vals = exact_median_values(df, cols, **kw)
    return df.sparkSession.createDataFrame([tuple(vals[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


def nearest_rank(df: DataFrame, col: str, q: float, **kw):
    """Value at sorted index round(q·(n−1)) (the 'nearest' interpolation)."""
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    st = d.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    if st["n"] == 0:
        return None
    k = int(math.floor(q * (st["n"] - 1) + 0.5))
    return _kth(d, "v", k, st["mn"], st["mx"], 0, st["n"], kw.get("bins", 4096), kw.get("collect_limit", 100_000))


# ---------------------------------------------------------------- sorted running totals
def ordered_totals(df: DataFrame, keys, order: str, sums) -> DataFrame:
    """``run_<c>`` (sum of ``c`` up to and including the row), ``all_<c>`` (sum over its key) for each ``c`` of ``sums``, and
    ``next_<order>`` (the following value of its key, NULL at the last).

    ``(keys, order)`` must be unique. The rows are cut into ranges of (keys, order) of even size by sampling, so a key that
    holds most rows lies in many ranges; a window sees one range of one key, and the range totals (one row per range and key)
    give every range its offset. NULL keys form a key of their own."""
    keys = list(keys)
    kept = _ckpt(df)                                         # the sampling and the exchange read it
    ranged = _ckpt(kept.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    by_key = Window.partitionBy(*keys).orderBy("_range")
    before, whole = by_key.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(F.min(F.struct(order)).alias("_first"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"),
                           F.lead("_first").over(by_key).alias("_next"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
                           *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(totals, same).withColumns({
        **{f"run_{c}": F.col(f"_o_{c}") + F.sum(c).over(up_to) for c in sums},
        f"next_{order}": F.coalesce(F.lead(F.struct(order)).over(inside), F.col("_next"))[order]})
    return out.drop("_range", "_at", "_next", *[f"_k{i}" for i in range(len(keys))], *[f"_o_{c}" for c in sums])


def grouped_quantile(counted: DataFrame, keys, value: str, count: str, q: float, out: str) -> DataFrame:
    """Exact interpolated quantile of every key from its (value, count) rows. No task gathers the values of a key
    (``ordered_totals``); the two ranks are then picked by an aggregation that combines before it shuffles. NULL values do
    not count; a key without any other value has a NULL quantile."""
    keys = list(keys)
    d = counted.select(*keys, F.col(value).cast("double").alias("_v"),
                       F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.col(count)).cast("long").alias("_c"))
    pos = F.lit(q) * (F.col("all__c") - 1)
    picked = ordered_totals(d, keys, "_v", ["_c"]).groupBy(*keys).agg(
        F.min(F.when(F.col("run__c") > F.floor(pos), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("run__c") > F.ceil(pos), F.col("_v"))).alias("_hi"), F.max(pos).alias("_pos"))
    part = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                         .otherwise((1 - part) * F.col("_lo") + part * F.col("_hi")).alias(out))
