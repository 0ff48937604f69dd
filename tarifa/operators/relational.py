"""Relational operators: projections, filters, joins, aggregations, ranking, splits.

Every function takes and returns DataFrames and stays declarative, so Catalyst pushes
filters and column pruning into the scans. None of them collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results: id / free-text / leakage columns.
LEAKAGE_14 = ["searchid", "date", "name", "detail", "destination_name", "destination_code",
              "hid", "geo_id", "main_city_oid", "date_search", "date_ci",
              "price_by_night", "price_by_night_adult", "target"]
LEAKAGE_15 = LEAKAGE_14 + ["min_query_price"]
LEAKAGE_16 = LEAKAGE_15 + ["hotel_id_extra"]
LEAKAGE = {14: LEAKAGE_14, 15: LEAKAGE_15, 16: LEAKAGE_16}

# Fixed values that must equal the reference's results: the configured feature list.
FEATURES = [
    "position", "adults", "children", "infants", "duration", "anticipation",
    "starRating", "avgRating", "ratio_expectativa",
    "avgRatingCleaning", "avgRatingInternetAccessAndQuality", "avgRatingLocation",
    "avgQualityprice", "avgServicepersonal", "avgService",
    "numberOfRooms", "total_amenities",
    "wday_ci_sine", "wday_ci_cosine",
    "is_carnaval_2024", "is_rock_in_rio_2024", "is_reveillon_2024", "is_carnaval_2025",
    "dist_gig_m", "dist_sdu_m", "dist_metro_m", "dist_favela_m",
    "favela_cercana_size", "favela_densidad_viviendas", "favela_vulnerabilidad_salud",
    "dist_cristo_m", "dist_playa_m", "density_kde",
    "dist_mean_5nn", "dist_mean_10nn", "dist_mean_20nn",
]
TARGET = "price_by_night_person"


# ---------------------------------------------------------------- sources
def read_table(spark, path: str, schema=None, fmt: str | None = None, header: bool = True) -> DataFrame:
    """Read a table with a declared schema (no inference). CSV or parquet by suffix."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", header).csv(path)
    return reader.format(fmt).load(path)


# ---------------------------------------------------------------- projections / filters
def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter (pushed into the scan)."""
    return df.filter(F.col(col) == F.lit(value))


def require(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


def drop_leakage(df: DataFrame, variant: int = 16, target: str | None = None) -> DataFrame:
    """Drop id / text / leakage columns; absent names are no-ops."""
    names = LEAKAGE[variant] + ([target] if target else [])
    return df.drop(*names)


def select_features(df: DataFrame, features=None, strict: bool = False) -> DataFrame:
    """Keep the configured features that exist (all must exist when ``strict``)."""
    features = FEATURES if features is None else features
    missing = [c for c in features if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*[c for c in features if c in df.columns])


def align_columns(df: DataFrame, expected, fill=0) -> DataFrame:
    """P5: exactly ``expected`` in order; absent columns become ``fill``; extras are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in expected])


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop NULL and blank (after trim) values."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def varying_columns(df: DataFrame, cols) -> DataFrame:
    """P10: columns with more than one distinct non-NULL value, as rows ``(column_name)``.

    One aggregation pass with min/max per column (partial aggregation, no distinct shuffle)."""
    stats = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols])
    rows = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col(f"`{c}`.lo") < F.col(f"`{c}`.hi")).alias("v"))
        for c in cols])).alias("s"))
    return rows.filter(F.col("s.v")).select("s.column_name")


def row_at(df: DataFrame, order_by, i: int) -> DataFrame:
    """The i-th row (0-based) under an explicit total order."""
    return df.orderBy(*order_by).offset(i).limit(1)


# ---------------------------------------------------------------- joins
def join_hotels(searches: DataFrame, amen: DataFrame) -> DataFrame:
    """Searches ⟕ hotel attributes on hid = hotel_id. AQE broadcasts the hotel side when
    its runtime size is under the threshold, otherwise a sort-merge join is kept."""
    return searches.join(amen, searches["hid"] == amen["hotel_id"], "left")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Membership filter as a left-semi join. The keys are made distinct first (map-side combine),
    so a key that holds a third of the right rows reaches the join once."""
    names = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*names).distinct(), on=names, how="left_semi")


# ---------------------------------------------------------------- aggregations
def hotel_medians(df: DataFrame, keys=("hid", "longitude", "latitude"), value: str = TARGET,
                  out: str = "precio_mediano") -> DataFrame:
    """A1: exact interpolated median per hotel, skew-safe.

    Stage 1 counts each (hotel, price) pair — its shuffle is keyed by the price too, so a hotel
    holding a third of all rows spreads over many tasks, and map-side combine collapses
    repeated prices. Stage 2 sorts the pairs into even ranges and adds up counts range by range
    (``quantiles.grouped_quantile``), so a hotel's distinct prices need not fit one task either."""
    from .quantiles import grouped_quantile
    keys = list(keys)
    # NULL prices stay as their own (skipped) group, so all-NULL hotels keep a NULL median
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return grouped_quantile(counted, keys, value, "_n", 0.5, out)


def group_means(df: DataFrame, key: str, cols) -> DataFrame:
    """A2: means per non-NULL group key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def global_means(df: DataFrame, cols) -> DataFrame:
    """A3: one-row table of column means."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def medians(df: DataFrame, cols) -> DataFrame:
    """A4: one-row table of exact column medians, by bounded histogram refinement (no task
    ever holds a whole column; see ``quantiles``)."""
    from .quantiles import exact_medians
    return exact_medians(df, list(cols))


def mode_value(df: DataFrame, col: str):
    """Most frequent non-NULL value (ties → smallest), as a scalar. Counting is a distributed
    groupBy; the pick is a ``min_by`` over (−count, value) with an O(1) buffer — no task ever
    holds a map of all distinct values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("_c"), F.col(col)))).first()[0]


def modes(df: DataFrame, cols, missing: str = "Missing") -> DataFrame:
    """A5: one-row table of modes (ties → smallest); all-NULL column → ``missing``."""
    vals = [mode_value(df, c) for c in cols]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = tuple(missing if v is None else v for v in vals)
    schema = ", ".join(f"`{c}` {types[c] if types[c] == 'string' else 'string'}" for c in cols)
    return df.sparkSession.createDataFrame([tuple(str(v) for v in row)], schema)


def total_amenities(cols) -> Column:
    """Row-wise sum, NULL counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def largest_segment(df: DataFrame, key: str) -> DataFrame:
    """The most frequent key (ties → smallest key)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(1)


def regression_metrics(df: DataFrame, y: str, preds, by=None) -> DataFrame:
    """MAE, MSE, RMSE, R² per model in one wide aggregate, its row(s) then unpivoted. A model is
    judged on the rows where both its prediction and the label are present; ``n`` counts those."""
    by = list(by or [])
    preds = list(preds)
    aggs = []
    for i, p in enumerate(preds):
        err = F.col(p).cast("double") - F.col(y)
        aggs += [F.count(err).alias(f"_n{i}"), F.avg(F.abs(err)).alias(f"_a{i}"), F.avg(err * err).alias(f"_s{i}"),
                 F.var_pop(F.when(err.isNotNull(), F.col(y))).alias(f"_v{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(p).alias("model"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mae"), F.col(f"_s{i}").alias("mse"),
                 F.col(f"_v{i}").alias("var")) for i, p in enumerate(preds)])).alias("_m"))
    return rows.select(*by, "_m.model", "_m.n", "_m.mae", "_m.mse", F.sqrt("_m.mse").alias("rmse"),
                       (1 - F.try_divide(F.col("_m.mse"), F.col("_m.var"))).alias("r2")).where("n > 0")


def distance_summary(df: DataFrame, col: str, q: float = 0.9, interpolation: str = "nearest") -> DataFrame:
    """A10: exact median, min and q-quantile of a column, as a one-row table.

    ``nearest`` is the value at sorted index round(q·(n−1)); ``linear`` interpolates. Both
    use bounded histogram refinement instead of a sort or a single-task aggregate."""
    from pyspark import StorageLevel
    from .quantiles import exact_quantiles, nearest_rank
    spark = df.sparkSession
    # one column, kept for the several passes below
    v = df.select(F.col(col).cast("double").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    qs = exact_quantiles(v, "v", [0.5, q])
    mn = v.agg(F.min("v")).first()[0]
    pq = nearest_rank(v, "v", q) if interpolation == "nearest" else qs[q]
    v.unpersist()
    return spark.createDataFrame([(qs[0.5], None if mn is None else float(mn), pq)],
                                 f"median double, min double, p{int(round(q * 100))} double")


def cv_summary(scores: DataFrame, config: str = "config", metrics=("mae", "rmse", "r2")) -> DataFrame:
    """Fold-averaged metrics per configuration."""
    return scores.groupBy(config).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def attribution_summary(long: DataFrame, k: int = 5, feature: str = "feature",
                        value: str = "attribution") -> DataFrame:
    """Mean |attribution| per feature, top k (ties → feature name)."""
    return (long.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs"))
            .orderBy(F.desc("mean_abs"), F.asc(feature)).limit(k))


def leaderboard(metrics: DataFrame, base_models=None, stack: str | None = None) -> DataFrame:
    """Models ordered by MAE; with ``stack`` given, the stack's RMSE gain over its best base."""
    out = metrics.select("model", "mae", "r2", "rmse")
    if stack is not None and base_models:
        # one scalar from the metric table (one row per model)
        best = metrics.filter(F.col("model").isin(list(base_models))).agg(F.min("rmse")).first()[0]
        out = out.withColumn("gain_vs_best_base",
                             F.when(F.col("model") == stack, F.lit(best) - F.col("rmse")) if best is not None
                             else F.lit(None).cast("double"))
    return out.orderBy("mae", "model")


# ---------------------------------------------------------------- ranking
def first_per(df: DataFrame, key: str, order) -> DataFrame:
    """First row per key under ``order``; ``min_by`` over a struct keeps it a hash
    aggregate with map-side combine instead of a window that sorts each key's rows."""
    order = list(order)
    cols = [c for c in df.columns if c != key]
    ordkey = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(key).agg(F.min_by(packed, ordkey).alias("_r")).select(key, "_r.*")


def best_fraction(metrics: DataFrame, score: str = "rmse", key: str = "config_id",
                  keep: float = 0.5, min_keep: int = 3, n: int | None = None) -> DataFrame:
    """Keep the best half (at least ``min_keep``) by score, ties → key. ``n`` is the number
    of configurations (known by the caller: the schedule fixes it)."""
    if n is None:
        n = metrics.count()
    k = max(min_keep, int(n * keep))
    return metrics.orderBy(F.asc(score), F.asc(key)).limit(k)


def vote_finalists(metrics: DataFrame, key: str = "idx") -> DataFrame:
    """Five criteria — lowest CV RMSE, lowest CV MAE, highest CV R², lowest validation
    RMSE, lowest validation MAE — each give one vote; most votes wins; every tie goes to the
    lowest index. Returns votes per finalist ordered by the decision."""
    crit = metrics.agg(
        F.min_by(key, F.struct("cv_rmse", key)).alias("c1"),
        F.min_by(key, F.struct("cv_mae", key)).alias("c2"),
        F.min_by(key, F.struct(-F.col("cv_r2"), F.col(key))).alias("c3"),
        F.min_by(key, F.struct("val_rmse", key)).alias("c4"),
        F.min_by(key, F.struct("val_mae", key)).alias("c5"),
    )
    votes = crit.select(F.explode(F.array("c1", "c2", "c3", "c4", "c5")).alias(key)) \
        .groupBy(key).agg(F.count(F.lit(1)).alias("votes"))
    return metrics.select(key).join(votes, key, "left") \
        .select(key, F.coalesce("votes", F.lit(0)).alias("votes")) \
        .orderBy(F.desc("votes"), F.asc(key))


def distinct_capped(df: DataFrame, col: str, n: int, order: str) -> DataFrame:
    """Distinct values in first-appearance order, first ``n`` (a top-n report)."""
    return (df.groupBy(col).agg(F.min(order).alias("first_seen"))
            .orderBy("first_seen", col).limit(n))


# ---------------------------------------------------------------- sets, splits, samples
def union_splits(*dfs: DataFrame) -> DataFrame:
    """Vertical concat by name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def key_hash(*keys) -> Column:
    """Deterministic 32-bit hash of a key's string form: the first 8 hex digits of its MD5,
    which DuckDB reproduces exactly (``rand``/``xxhash64`` have no DuckDB twin)."""
    s = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def session_split(df: DataFrame, key: str = "searchid", fracs=(70, 15, 15), out: str = "split") -> DataFrame:
    """Whole sessions go to train/val/test by a hash bucket of the key (percent cuts).
    No shuffle, no driver state: each row decides from its own key."""
    b = key_hash(key) % 100
    return df.withColumn(out, F.when(b < fracs[0], "train")
                         .when(b < fracs[0] + fracs[1], "val").otherwise("test"))


TOP_K = 10_000


def sample_n(df: DataFrame, n: int, key, seed: int = 42, tiebreak=()) -> DataFrame:
    """U4: a stable sample of exactly ``min(n, rows)`` rows: the n smallest seeded key hashes. Up to
    TOP_K rows are a top-k, where each task hands on at most n; for more, the n-th hash is located by
    histogram passes and rows are filtered against it, so no task merges the sample."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"),
                                             *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    d = df.withColumn("_h", h)
    if n <= TOP_K:
        return d.orderBy("_h", *keys, *tiebreak).limit(n).drop("_h")
    from .quantiles import _kth
    st = d.agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("mn"), F.max("_h").alias("mx")).first()
    if st["n"] <= n:
        return df
    cut = int(_kth(d.select(F.col("_h").cast("double").alias("_h")), "_h", n - 1, float(st["mn"]), float(st["mx"]),
                   0, st["n"], 4096, 100_000))
    below = d.filter(F.col("_h") < F.lit(cut))
    # rows with exactly the n-th hash are few
    ties = d.filter(F.col("_h") == F.lit(cut)).orderBy(*keys, *tiebreak).limit(n - below.count())
    return below.unionByName(ties).drop("_h")


def assign_folds(df: DataFrame, k: int, key, group: str | None = None, out: str = "fold") -> DataFrame:
    """fold = hash(row key) mod k; with ``group`` whole groups share a fold."""
    keys = [group] if group else ([key] if isinstance(key, str) else list(key))
    return df.withColumn(out, (key_hash(*keys) % k).cast("int"))


def _session_at_rank(sess: DataFrame, key: str, k: int):
    """(hash, key) of the session at 0-based rank k in (hash, key) order, or None past the end."""
    from .quantiles import _kth
    st = sess.agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("mn"), F.max("_h").alias("mx")).first()
    if k >= st["n"]:
        return None
    t = int(_kth(sess.select(F.col("_h").cast("double").alias("_h")), "_h", k, float(st["mn"]), float(st["mx"]),
                 0, st["n"], 4096, 100_000))
    below = sess.filter(F.col("_h") < F.lit(t)).count()
    # sessions sharing one 32-bit hash are few: order them by key on the driver
    ties = sorted(r[0] for r in sess.filter(F.col("_h") == F.lit(t)).select(key).collect())
    return t, ties[k - below]


def session_split_exact(df: DataFrame, key: str = "searchid", fracs=(70, 15, 15), out: str = "split") -> DataFrame:
    """U3 with the reference's sizes: of n distinct sessions ranked by (hash(key), key), the
    first ⌊70n/100⌋ are train, the next ⌊15n/100⌋ val, the rest test. The two cut sessions
    are found by bounded histogram passes; rows are then labelled from their own key."""
    from pyspark import StorageLevel
    sess = df.select(key).distinct().withColumn("_h", key_hash(key)).persist(StorageLevel.MEMORY_AND_DISK)
    n = sess.count()
    n_tr = n * fracs[0] // 100
    n_va = n * fracs[1] // 100
    c1 = _session_at_rank(sess, key, n_tr)
    c2 = _session_at_rank(sess, key, n_tr + n_va)
    sess.unpersist()
    h = key_hash(key)

    def before(cut):
        if cut is None:
            return F.lit(True)
        return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (F.col(key) < F.lit(cut[1])))
    return df.withColumn(out, F.when(before(c1), "train").when(before(c2), "val").otherwise("test"))
