"""Density-ratio search, genetic programming, sorted running totals, split search by range, co-located points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import evolution as EV
from tarifa.operators import quantiles as Q
from tarifa.operators import relational as R
from tarifa.operators import reports as RP
from tarifa.operators import search as SE
from tarifa.operators import spatial as SP
from tarifa.operators.routing import BestFirstRouter, best_splits, columns_like


def surface(c):
    return -((math.log10(c["rate"]) + 1.5) ** 2) - ((c["depth"] - 7) / 4) ** 2 - (c["x"] - 0.8) ** 2


SPACE = {"rate": SE.Range(0.001, 1.0, log=True), "depth": SE.Range(3, 10, 1), "x": SE.Range(-1.0, 1.0)}


def test_search_beats_random():
    def best(n_start, seed):
        return max(s for _, s in SE.density_ratio_search(lambda cs: [surface(c) for c in cs], SPACE, 40, n_start, 1, seed=seed))
    ratio, drawn = [best(8, s) for s in range(15)], [best(40, s) for s in range(15)]
    assert np.median(ratio) > np.median(drawn) and sum(a > b for a, b in zip(ratio, drawn, strict=True)) >= 11


@pytest.mark.parametrize("batch", [1, 4])
def test_search_depends_on_earlier_trials(batch):
    one = SE.density_ratio_search(lambda cs: [surface(c) for c in cs], SPACE, 20, 5, batch, seed=1)
    other = SE.density_ratio_search(lambda cs: [-surface(c) for c in cs], SPACE, 20, 5, batch, seed=1)
    assert [c for c, _ in one[:5]] == [c for c, _ in other[:5]] and [c for c, _ in one[5:]] != [c for c, _ in other[5:]]
    for c, _ in one + other:
        assert 0.001 <= c["rate"] <= 1 and c["depth"] in range(3, 11) and -1 <= c["x"] <= 1
    assert len(one) == 20
    assert len(SE.density_ratio_search(lambda cs: [None for _ in cs], SPACE, 9, 3, batch)) == 9


def test_parzen_is_a_density():
    for points in ([], [0.0], [0.5, 0.5, 0.5], [0.1, 0.9, 1.0]):
        p = SE.Parzen(points)
        assert abs(sum(p.density((i + 0.5) / 5000) for i in range(5000)) / 5000 - 1) < 1e-3
        rnd = random.Random(0)
        assert all(0 <= p.draw(rnd) <= 1 for _ in range(100))


def test_boosted_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(a), float(b), float(math.exp(0.5 * a) * 20 + 3 * b + rng.random()), bool(i % 4 == 0))
            for i, (a, b) in enumerate(rng.random((800, 2)) * 3)]
    d = spark.createDataFrame(rows + [(999, 1.0, 1.0, None, True)], "id long, a double, b double, y double, v boolean")
    got = SE.boosted_search(d, F.col("v"), ["a", "b"], "y", n_trials=4, n_start=2, batch=2, round_cap=40).orderBy("trial").collect()
    assert [r["trial"] for r in got] == [0, 1, 2, 3] and all(1 <= r["trees"] <= 40 for r in got) and max(r["r2"] for r in got) > 0.8


# ---------------------------------------------------------------- genetic programming
def test_programs_equal_their_columns(spark):
    rnd = random.Random(4)
    rows = [(float(a), float(b)) for a, b in np.random.default_rng(4).normal(0, 30, (300, 2))] + [(0.0, 0.0), (0.0005, -0.0005), (1e9, -1e9), (1e200, 1e200)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    breeder = EV.Breeder(["a", "b"], rnd, max_nodes=20)
    trees = [breeder.first() for _ in range(60)]
    got = np.array(df.select(*[EV.sanitize(EV.as_column(t, {"a": F.col("a"), "b": F.col("b")})).alias(f"t{i}") for i, t in enumerate(trees)]).collect())
    x = np.array(rows)
    want = EV.evaluate(trees, {"a": x[:, 0], "b": x[:, 1]}, len(x)).T
    smooth = np.abs(x).max(axis=1) < 1e8                      # sine of huge numbers differs by library
    assert np.allclose(got[smooth], want[smooth], rtol=1e-4, atol=1e-4)


def test_correlations_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (5000, 2))
    y = 1e7 + x[:, 0] * 2 + rng.normal(0, 1, 5000)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, y double").repartition(40)
    trees = ["a", ("mul", "a", "b"), ("add", "a", "b"), ("sub", "a", "a"), ("sin", "a")]
    z = EV.evaluate(trees, {"a": x[:, 0], "b": x[:, 1]}, 5000)
    want = [0.0 if z[i].std() == 0 else abs(np.corrcoef(z[i], y)[0, 1]) for i in range(5)]
    assert np.allclose(EV.correlations(df, ["a", "b"], "y", trees), want, atol=1e-9)
    assert EV.correlations(df.limit(0), ["a", "b"], "y", trees).tolist() == [0.0] * 5


def test_programs_keep_no_value_after_its_last_use():
    """the values of all nodes of a population were held at once."""
    b = EV.Breeder(["a", "b"], random.Random(8), max_nodes=64)
    trees = [b.first() for _ in range(400)]
    trees += [b.crossover(s, t) for s, t in zip(trees, trees[1:], strict=False)]
    nodes = set()

    def walk(t):
        if isinstance(t, tuple) and t not in nodes:
            nodes.add(t)
            for a in t[1:]:
                walk(a)
    for t in trees:
        walk(t)
    p = EV.Programs(trees)
    assert p.held < len(nodes) / 3 and len(p.steps) == len(nodes) + len(trees)
    x = {"a": np.linspace(-3, 3, 50), "b": np.linspace(5, -1, 50)}
    assert np.array_equal(EV.evaluate(trees, x, 50), np.array([EV.evaluate([t], x, 50)[0] for t in trees]))


def test_variation():
    b = EV.Breeder(["a", "b"], random.Random(6), max_nodes=40)
    trees = [b.first() for _ in range(200)]
    crossed = [(s, t, b.crossover(s, t)) for s, t in zip(trees, trees[1:], strict=False)]

    def parts(t):
        return {t} | {p for x in (t[1:] if isinstance(t, tuple) else ()) for p in parts(x)}
    assert any(c not in (s, t) and (parts(c) & parts(t)) - parts(s) for s, t, c in crossed)
    assert all(EV.size(b.hoist(t)) <= EV.size(t) for t in trees)
    assert all(EV.size(b.point(t)) == EV.size(t) for t in trees)
    assert all(EV.size(b.child(lambda: random.Random(0).choice(trees), 0.9, 0.03, 0.03, 0.04)) <= 40 for _ in range(300))
    corr = np.array([[1, 0.99, 0.1, 0.2], [0.99, 1, 0.1, 0.2], [0.1, 0.1, 1, 0.9], [0.2, 0.2, 0.9, 1]])
    assert EV.least_correlated(corr, 2) == [0, 2]


def test_evolution_finds_a_product(spark):
    rng = np.random.default_rng(7)
    x = rng.random((1500, 3)) * 4
    rows = [(i, float(a), float(b), None if i % 50 == 0 else float(c), float(a * b + 0.01 * c) if i % 70 else None) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    ev = EV.EvolvedFeatures(["a", "b", "c"], "id", population=150, generations=6, hall_of_fame=20, seed=1).fit(df, "y")
    assert ev.best[0][1] > 0.99 and ev.history[-1] >= ev.history[0] and len(ev.best) == 3
    out = ev.transform(df)
    assert [c for c in out.columns if c.startswith("symbolic")] == ["symbolic_feat_1", "symbolic_feat_2", "symbolic_feat_3"]
    assert out.where("y IS NOT NULL").selectExpr("abs(corr(symbolic_feat_1, y)) AS r").first()["r"] > 0.99
    assert len({f for f, _, _ in ev.best}) == 3


# ---------------------------------------------------------------- ordered totals
def test_grouped_medians_of_a_hot_group(spark):
    rng = random.Random(8)
    rows = [("hot", rng.gauss(100, 30)) for _ in range(4000)] + [(f"g{rng.randrange(200)}", float(rng.randrange(9))) for _ in range(4000)]
    rows += [("null", None), ("null", None), (None, 3.0), (None, 8.0), ("one", 7.5), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    got = {r["g"]: r["m"] for r in R.hotel_medians(df, ("g",), "v", "m").collect()}
    groups: dict = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None]
        assert got[g] == (pytest.approx(float(np.median(vs))) if vs else None)


def test_ordered_totals_over_ranges(spark):
    rows = [(k, float(v), v % 5) for k in ("a", None, "b") for v in range(2000 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, v double, c long").repartition(5)
    out = Q.ordered_totals(df, ["k"], "v", ["c"]).collect()
    assert len(out) == len(rows)
    want = {}
    for k in ("a", None, "b"):
        mine, run = sorted((v, c) for q, v, c in rows if q == k), 0
        for i, (v, c) in enumerate(mine):
            run += c
            want[k, v] = (run, sum(x for _, x in mine), mine[i + 1][0] if i + 1 < len(mine) else None)
    assert {(r["k"], r["v"]): (r["run_c"], r["all_c"], r["next_v"]) for r in out} == want


def test_exact_split_of_a_continuous_feature(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random(3000), rng.random(3000)
    y = np.where(a > 0.37, 10.0, 0.0) + b
    df = spark.createDataFrame([(float(i), float(j), float(k)) for i, j, k in zip(a, b, y, strict=True)], "a double, b double, y double")
    got = best_splits(df.withColumn("leaf", F.lit(0)), "y", ["a", "b"], "leaf", 50).first()
    best = None
    for f, x in (("a", a), ("b", b)):
        order = np.argsort(x)
        v, t = x[order], y[order]
        sl, n = np.cumsum(t)[:-1], np.arange(1, 3000)
        gain = sl ** 2 / n + (t.sum() - sl) ** 2 / (3000 - n) - t.sum() ** 2 / 3000
        gain[:49], gain[-49:] = -1, -1
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (gain[i], f, (v[i] + v[i + 1]) / 2, i + 1)
    assert (got["feature"], got["threshold"], got["n_left"]) == best[1:]


def test_columns_like(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3, 4.0)], "starRating double, dist_metro_m double, nameRating string, mca_dim_1 int, price double")
    assert columns_like(df, ("mca_dim", "dist_", "rating", "numberofrooms")) == ["starRating", "dist_metro_m", "mca_dim_1"]
    assert BestFirstRouter(columns_like(df, ("rating",))).features == ["starRating"]


def test_scatter_sample(spark):
    df = spark.createDataFrame([(i, float(i), float(i + 1), None if i == 3 else float(i - 1)) for i in range(50)], "id long, y double, p double, q double")
    got = RP.scatter_sample(df, "y", ["p", "q"], "id", 20).collect()
    ids = {r["id"] for r in got}
    assert len(ids) == 20 and len(got) == 40 - (3 in ids)
    assert all(r["error"] == (1.0 if r["model"] == "p" else -1.0) for r in got)


# ---------------------------------------------------------------- co-located points
@pytest.mark.parametrize("tie", ["id", None])
def test_nearest_with_a_hot_spot(spark, tie):
    rng = random.Random(10)
    pts = [(i, 0.25, 0.5) for i in range(1500)] + [(1500 + i, rng.random(), rng.random()) for i in range(700)] + [(5000, -0.0, 0.0), (5001, 0.0, -0.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    asked = df.unionByName(spark.createDataFrame([(9000, None, 1.0)], "id long, x double, y double"))
    got = {r["id"]: r["nn"] for r in SP.nearest_k(asked, "id", "x", "y", df, "x", "y", 5, payload=["id"], tie=tie, small_points=0, chunk=128).collect()}
    xy = np.array([p[1:] for p in pts])
    ids = np.array([p[0] for p in pts])
    assert got.keys() == {*ids.tolist(), 9000} and got[9000] == []
    for i in [0, 1499, *range(1500, 2200, 23), 2200]:
        d = np.hypot(*(xy - xy[i]).T)
        order = np.lexsort((ids, np.round(d, 9)))[:5]
        nn = got[int(ids[i])]
        assert [r["d"] for r in nn] == pytest.approx(d[order].tolist(), abs=1e-9)
        if tie:
            assert [r["tie"] for r in nn] == ids[order].tolist()


def test_hot_spot_costs_no_more_than_spread(spark):
    import time

    def run(hot):
        rng = random.Random(11)
        pts = [(i, 0.3, 0.3) if hot and i < 10_000 else (i, rng.random(), rng.random()) for i in range(12_000)]
        df = spark.createDataFrame(pts, "hid long, longitude double, latitude double").withColumn("precio_mediano", F.col("hid") * 1.0).persist()
        df.count()
        t = time.time()
        n = SP.knn_features(df, df).where("precio_mean_5nn IS NOT NULL").count()
        return n, time.time() - t
    run(False)
    spread, hot = run(False), run(True)
    assert spread[0] == hot[0] == 12_000 and hot[1] < 2 * spread[1] + 1
