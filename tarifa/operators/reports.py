"""Report queries (R8–R11): plain aggregations over prediction and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relational as R


def pred_vs_actual(df: DataFrame, y: str, preds) -> DataFrame:
    """RMSE, R² and a common axis range per model (one pass)."""
    m = R.regression_metrics(df, y, preds)
    rng = df.select(*[F.struct(F.lit(p).alias("model"), F.least(F.col(y), F.col(p)).alias("lo"),
                               F.greatest(F.col(y), F.col(p)).alias("hi")).alias(p) for p in preds])
    rng = rng.select(F.explode(F.array(*preds)).alias("r")).groupBy("r.model") \
        .agg(F.min("r.lo").alias("axis_min"), F.max("r.hi").alias("axis_max"))
    return m.join(rng, "model").select("model", "rmse", "r2", "axis_min", "axis_max")


def scatter_sample(df: DataFrame, y: str, preds, key, n: int, seed: int = 42) -> DataFrame:
    """The points of the scatter plots, a stable sample of ``n`` rows: one row per (row, model) with key, model, actual,
    predicted and error. All models show the same rows. NULL predictions give no point."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = R.sample_n(df.select(*keys, y, *preds).where(F.col(y).isNotNull()), n, keys, seed=seed, tiebreak=[y])
    models = F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).cast("double").alias("predicted")) for p in preds])
    return rows.select(*keys, F.col(y).cast("double").alias("actual"), F.explode(models).alias("m")) \
        .where("m.predicted IS NOT NULL") \
        .select(*keys, "m.model", "actual", "m.predicted", (F.col("m.predicted") - F.col("actual")).alias("error"))


def audit(preds: DataFrame, hotel: str = "hotel", y: str = "precio_real",
          a: str = "prediccion_huber", b: str = "prediccion_ridge", order=("searchid", "position")) -> DataFrame:
    """For every named hotel its first prediction row, with both deltas."""
    named = R.non_blank(preds, hotel)
    cols = list(dict.fromkeys([hotel, y, a, b, *order]))
    first = R.first_per(named.select(*cols), hotel, list(order))
    return first.select(hotel, y, a, b, (F.col(a) - F.col(y)).alias("delta_huber"),
                        (F.col(b) - F.col(y)).alias("delta_ridge"))


def feature_sample(df: DataFrame, cols, n: int, key: str, seed: int = 42) -> DataFrame:
    """A stable sample of ``n`` rows of some feature columns."""
    return R.sample_n(df.select(key, *cols), n, key, seed=seed)


def segment_profile(df: DataFrame, segment: str, y: str, cols) -> DataFrame:
    """Size, mean and median target and column means per segment. The exact median weighs distinct
    prices by their counts (A1), so a segment of a third of all rows is not gathered row by row."""
    means = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_price"),
                                    *[F.avg(c).alias(f"mean_{c}") for c in cols])
    med = R.hotel_medians(df, (segment,), y, "median_price").withColumnRenamed(segment, "_segment")
    return means.join(med, F.col(segment).eqNullSafe(F.col("_segment"))).select(
        segment, "n", "mean_price", "median_price", *[f"mean_{c}" for c in cols])
