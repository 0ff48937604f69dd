"""Grid paths of the spatial operators equal their exact (packed) paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import spatial as SP


def _pts(spark, n, seed, name="id", clustered=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if clustered and i % 3 == 0:  # a hot cell holding a third of the points
            rows.append((i, -43.2 + rnd.random() * 1e-3, -22.9 + rnd.random() * 1e-3))
        else:
            rows.append((i, -43.5 + rnd.random() * 0.4, -23.1 + rnd.random() * 0.3))
    return spark.createDataFrame(rows, f"{name} long, x double, y double")


@pytest.mark.parametrize("metric,k", [("haversine", 1), ("euclid", 1), ("euclid", 7)])
def test_nearest_grid_equals_exact(spark, metric, k):
    q = _pts(spark, 300, 1, "qid")
    p = _pts(spark, 900, 2, "pid", clustered=True)
    exact = SP.nearest_k(q, "qid", "x", "y", p, "x", "y", k=k, tie="pid", metric=metric, small_points=10 ** 9)
    if k > 1:  # the packed path for k > 1 applies only to tiny point sets; build the reference by brute force
        qs, ps = q.collect(), p.collect()
        exp = {}
        for r in qs:
            ds = sorted((round(math.hypot(s.x - r.x, s.y - r.y), 9), s.pid) for s in ps)[:k]
            exp[r.qid] = [t[1] for t in ds]
    else:
        exp = {r.qid: [e.tie for e in r.nn] for r in exact.collect()}
    grid = SP.nearest_k(q, "qid", "x", "y", p, "x", "y", k=k, tie="pid", metric=metric, small_points=0, chunk=16)
    got = {r.qid: [e.tie for e in r.nn] for r in grid.collect()}
    assert got == exp


def test_knn_features_grid_equals_bruteforce(spark):
    q = _pts(spark, 200, 3, "hid").withColumnRenamed("x", "longitude").withColumnRenamed("y", "latitude")
    t = _pts(spark, 400, 4, "hid").withColumnRenamed("x", "longitude").withColumnRenamed("y", "latitude") \
        .withColumn("hid", F.col("hid") + 10000).withColumn("precio_mediano", F.col("hid") * 1.5)
    # make some query hotels train hotels (self rule)
    q = q.unionByName(t.select("hid", "longitude", "latitude").limit(50))
    got = {r.hid: r for r in SP.knn_features(q, t).collect()}
    tr = t.collect()
    for r in q.collect():
        ds = sorted((round(math.hypot(s.longitude - r.longitude, s.latitude - r.latitude), 9), s.hid,
                     math.hypot(s.longitude - r.longitude, s.latitude - r.latitude), s.precio_mediano) for s in tr)[:21]
        sel = ds[1:] if ds[0][2] < 1e-5 else ds
        for k in (5, 10, 20):
            assert got[r.hid][f"precio_mean_{k}nn"] == pytest.approx(np.mean([s[3] for s in sel[:k]]), rel=1e-12)
            assert got[r.hid][f"dist_mean_{k}nn"] == pytest.approx(np.mean([s[2] for s in sel[:k]]), rel=1e-9)


def test_kde_grid_equals_exact_and_numpy(spark):
    df = _pts(spark, 500, 5, "hid", clustered=True)
    exact = {r.hid: r.density_kde for r in SP.kde2d(df, "hid", "x", "y", exact=True).collect()}
    grid = {r.hid: r.density_kde for r in SP.kde2d(df, "hid", "x", "y", chunk=32).collect()}
    rows = df.collect()
    xy = np.array([[r.x, r.y] for r in rows]).T
    n = xy.shape[1]
    cov = np.cov(xy) * n ** (-2.0 / 6.0)
    inv = np.linalg.inv(cov)
    d = xy[:, :, None] - xy[:, None, :]
    m = np.einsum("ijk,il,ljk->jk", d, inv, d)
    dens = np.exp(-0.5 * m).sum(axis=1) / (n * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    for i, r in enumerate(rows):
        assert grid[r.hid] == pytest.approx(exact[r.hid], rel=1e-9)
        assert exact[r.hid] == pytest.approx(dens[i], rel=1e-9)


def test_kde_forms_no_pairs_and_ignores_row_order(spark, monkeypatch):
    """the sums met every block of a 3 x 3 ring that spans most of the points; their last digits hung on the row order."""
    def pairs(*args, **kw):
        raise AssertionError("pairs of blocks")
    monkeypatch.setattr(SP, "_block_pairs", pairs)
    rnd = random.Random(12)
    rows = [(i, rnd.gauss(0, 3) + 40 * (i % 2), rnd.gauss(5, 0.2)) for i in range(700)] + [(i, 20.0, 5.0) for i in range(700, 900)] + [(900, 900.0, -7.0)]
    got = {}
    for parts in (1, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "hid long, x double, y double").repartition(parts)
        got[parts] = {r.hid: r.density_kde for r in SP.kde2d(df, "hid", "x", "y").collect()}
    assert got[1] == got[7] and len(got[1]) == len(rows)
    rows.sort()
    xy = np.array([r[1:] for r in rows])
    inv = np.linalg.inv(np.cov(xy.T) * len(rows) ** (-1.0 / 3.0))
    d = xy[:, None] - xy[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, inv, d)).sum(axis=1) * math.sqrt(np.linalg.det(inv)) / (len(rows) * 2 * math.pi)
    assert np.allclose([got[1][r[0]] for r in rows], want, rtol=1e-10, atol=0)


def test_kde_rejects_colinear(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(10)], "hid long, x double, y double")
    with pytest.raises(ValueError):
        SP.kde2d(df, "hid", "x", "y")


def test_nearest_area_defaults(spark):
    df = spark.createDataFrame([(1, -22.9, -43.2)], "hid long, latitude double, longitude double")
    r = SP.nearest_area(df, "hid", None).first()
    assert (r.dist_favela_m, r.favela_cercana_size, r.favela_densidad_viviendas, r.favela_vulnerabilidad_salud) == \
        (1200.0, 1000, 50.0, 0.5)


@pytest.mark.parametrize("metric", ["euclid", "haversine"])
def test_a_query_leaves_one_row_of_its_ring(spark, metric):
    """each point block of the ring sent k rows a query; the rows of all blocks were sorted whole."""
    q = _pts(spark, 400, 21, "key").withColumnRenamed("x", "qx").withColumnRenamed("y", "qy")
    p = _pts(spark, 2000, 22, "pid", clustered=True).withColumnRenamed("x", "px").withColumnRenamed("y", "py")
    pairs = SP._ring_pairs(q, p, ["pid"], 0.03, 10 ** 6, 16, SP._columns_around(metric, 0.03), 5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = pairs.mapInPandas(SP._topk_kernel(metric, 6, "key", "pid", ["pid"]), "key long, rd double, tie long, d double").collect()
    met = pairs.collect()
    blocks = {}
    for r in met:
        for key in r["q_key"]:
            blocks[key] = blocks.get(key, 0) + 1
    assert max(blocks.values()) <= 4 and sum(n == 1 for n in blocks.values()) > 200      # rows, not 9 and more, where blocks are of 16
    got = {}
    for r in rows:
        got.setdefault(r["key"], []).append((r["rd"], r["tie"]))
    for r in met:
        for key, x, y in zip(r["q_key"], r["q_x"], r["q_y"]):
            if blocks[key] == 1:
                d = np.round(SP._np_dist(metric, x, y, np.array(r["p_x"]), np.array(r["p_y"])), 9)
                assert got[key] == sorted(zip(d.tolist(), r["p_pid"]))[:6]


def test_knn_hot_spot_exact_and_adaptive(spark):
    """A third of the train points in one tiny spot: exact against brute force, and the
    starting cell shrinks to the spot's density."""
    rnd = random.Random(9)
    rows = []
    for i in range(1500):
        if i % 3 == 0:
            rows.append((i, -43.2 + rnd.random() * 1e-4, -22.9 + rnd.random() * 1e-4, float(i % 17)))
        else:
            rows.append((i, -43.5 + rnd.random() * 0.4, -23.1 + rnd.random() * 0.3, float(i % 17)))
    t = spark.createDataFrame(rows, "hid long, longitude double, latitude double, precio_mediano double")
    q = t.select("hid", "longitude", "latitude")
    got = {r.hid: r for r in SP.knn_features(q, t, ks=(5,), chunk=64).collect()}
    pts = t.collect()
    for r in rnd.sample(pts, 60):
        ds = sorted((round(math.hypot(s.longitude - r.longitude, s.latitude - r.latitude), 9), s.hid,
                     math.hypot(s.longitude - r.longitude, s.latitude - r.latitude), s.precio_mediano) for s in pts)[:6]
        sel = ds[1:] if ds[0][2] < 1e-5 else ds
        assert got[r.hid].precio_mean_5nn == pytest.approx(np.mean([s[3] for s in sel[:5]]), rel=1e-12)
    from pyspark.sql import functions as F
    base = math.sqrt(max(4 * 6 / 9, 64 / 4) * 0.4 * 0.3 / 1500)
    fitted = SP._densest_fit(t.select(F.col("longitude").alias("x"), F.col("latitude").alias("y")), "x", "y", base, 256)
    assert fitted < base / 4


def test_kde_binned_close_to_exact_on_hot_spot(spark):
    df = _pts(spark, 1200, 11, "hid", clustered=True)
    exact = {r.hid: r.density_kde for r in SP.kde2d(df, "hid", "x", "y", exact=True).collect()}
    binned = {r.hid: r.density_kde for r in SP.kde2d(df, "hid", "x", "y", bin_frac=0.001).collect()}
    worst = max(abs(binned[h] - exact[h]) / exact[h] for h in exact)
    assert worst < 9 * 0.001 * 0.71 * 1.5
