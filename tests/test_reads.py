"""Fits and scores that need their rows several times read the source once."""

import pytest
from pyspark.sql import functions as F

from tarifa.operators import boosting as BO
from tarifa.operators import scoring as SC
from tarifa.operators import tuning as TU
from tarifa.operators.symbolic import SymbolicFeatures


@pytest.fixture
def counted(spark):
    """(rows that count how often they are read, the counter)."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7 + 1).cast("double").alias("y"), "id",
                                (F.col("id") % 5 + 1).cast("double").alias("starRating"), (F.col("id") % 90).cast("double").alias("numberOfRooms"),
                                (F.col("id") % 9).cast("double").alias("total_amenities")).repartition(3).transform(lambda d: d.checkpoint())
    return d.mapInArrow(count, d.schema), seen


@pytest.mark.parametrize("spec", [BO.ExpertSpec("gbt", {"rounds": 1, "depth": 2}), BO.ExpertSpec("rf", {"trees": 2, "depth": 2})])
def test_a_tree_fit_reads_its_rows_once(spark, counted, spec):
    df, seen = counted
    m = BO.fit_expert(df, ["x"], "y", spec)
    assert seen.value == 400
    assert m.transform(df, "p").where("p is not null").count() == 400


def test_experts_of_all_segments_read_their_rows_once(spark, counted):
    df, seen = counted
    feats = ["starRating", "numberOfRooms", "total_amenities"]
    bundle = SC.fit_moe(df, feats, "y", BO.ExpertSpec("gbt", {"rounds": 1, "depth": 1}))
    assert len(bundle.models) > 1 and seen.value == 400
    seen.value = 0
    assert bundle.score(df, ["id"]).count() == 400
    assert seen.value == 400


def test_finalists_share_one_reading(spark, counted):
    df, seen = counted
    configs = [c | {"cv": {"rmse": 1.0, "mae": 1.0, "r2": 0.0}, "num_leaves": 3} for c in TU.random_configs(2)]
    TU.pick_finalist(spark, df, df.limit(100), ["x"], "y", configs, round_cap=1).collect()
    assert seen.value <= 800


def test_symbolic_search_reads_its_rows_once(spark, counted):
    df, seen = counted
    sym = SymbolicFeatures(["x", "starRating"], n_keep=2, generations=3, population=12).fit(df, "y")
    assert len(sym.best) == 2 and seen.value == 400
