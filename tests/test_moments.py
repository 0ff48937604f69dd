"""Centred co-moments and the linear models and components built on them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import linear as LIN
from tarifa.operators import moments as MO
from tarifa.operators.pca import scaled_pca


def test_moments_by_group_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(MO, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.1, 2] + [1e9, -1e8, 0, 7]
    g = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(g, x, strict=True)] + [(0, None, 1.0, 1.0, 1.0), (0, float("nan"), 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0, 4.0)],
                               "g int, a double, b double, c double, d double").repartition(6)
    got = MO.co_moments(df, ["a", "b", "c", "d"], "g")
    assert set(got) == {"0", "1", "2", None} and got[None].n == 1
    for k in range(3):
        own = x[g == k]
        c = own - own.mean(axis=0)
        assert got[str(k)].n == len(own) and np.allclose(got[str(k)].mean, own.mean(axis=0), rtol=1e-15)
        assert np.allclose(got[str(k)].m2, c.T @ c, rtol=1e-6, atol=1e-5)
    assert MO.co_moments(df.where("false"), ["a"]) == {}


def test_offset_line_and_constant_like_column(spark):
    df = spark.createDataFrame([(1e9 + i, 3.0 * i, float(i % 2)) for i in range(10)], "x double, y double, z double")
    m = LIN.ols(df, ["x"], "y")
    assert abs(m.coef[0] - 3) < 1e-9 and abs(m.intercept + 3e9) < 1e-2
    assert abs(scaled_pca(df, ["x", "z"], 2).sd[0] - np.std(np.arange(10))) < 1e-9
    with pytest.raises(ValueError):
        LIN.ols(df.where("false"), ["x"], "y")


def test_ridge_cv_equals_plain_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) + 50.0
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    fold = rng.integers(0, 4, 200)
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)], "a double, b double, c double, y double, fold int").repartition(3)
    alphas = [0.01, 1.0, 100.0, 1e4]
    m = LIN.ridge_cv(df, ["a", "b", "c"], "y", alphas=alphas, fold_col="fold")

    def fit(own, a):
        mx, my = x[own].mean(axis=0), y[own].mean()
        c = x[own] - mx
        w = np.linalg.solve(c.T @ c + a * np.eye(3), c.T @ (y[own] - my))
        return w, my - mx @ w

    score = {a: np.mean([1 - ((y[fold == f] - x[fold == f] @ w - b) ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum()
                         for f in range(4) for w, b in [fit(fold != f, a)]]) for a in alphas}
    best = max(score, key=score.get)
    w, b = fit(fold >= 0, best)
    assert m.params["alpha"] == best and abs(m.params["cv_score"] - score[best]) < 1e-9 and np.allclose(m.coef, w) and abs(m.intercept - b) < 1e-8


def test_three_hundred_features(spark):
    df = spark.range(0, 2000, 1, 4).select(*[F.rand(i).alias(f"f{i}") for i in range(300)])
    df = df.withColumn("y", F.col("f0") * 2 - F.col("f299") + 1)
    start = time.time()
    m = LIN.ols(df, [f"f{i}" for i in range(300)], "y")
    assert abs(m.coef[0] - 2) < 1e-8 and abs(m.coef[299] + 1) < 1e-8 and time.time() - start < 60


def test_huber_leaves_out_rows_with_nulls(spark):
    rows = [(float(i), 2.0 * i + 1 + (i % 3) * 0.1) for i in range(60)]
    clean = spark.createDataFrame(rows, "x double, y double")
    dirty = spark.createDataFrame([*rows, (None, 1.0), (3.0, None)], "x double, y double")
    a, b = LIN.huber(clean, ["x"], "y"), LIN.huber(dirty, ["x"], "y")
    assert abs(a.coef[0] - b.coef[0]) < 1e-6 and abs(a.intercept - b.intercept) < 1e-5
