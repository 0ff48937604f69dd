"""Edge fixtures for the semantics that bite."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tarifa.functions import numeric as N
from tarifa.functions import rules as RU
from tarifa.functions import temporal as TM
from tarifa.operators import relational as R
from tarifa.operators import transformers as T
from tarifa.operators.mca import MCA
from tarifa.plans import dataset as DS
from tarifa.sources import domain as D


def test_nan_becomes_null_before_means(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (3.0, 2.0)], "r double, s double")
    out = N.nan_to_null(df).agg(F.avg("r").alias("m")).first().m
    assert out == 2.0


def test_group_imputer_falls_back_to_global_mean(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 4.0), (2.0, 6.0), (None, None)], "s double, r double")
    imp = T.GroupImputer("s", ["r"], ratio=None).fit(df)
    rows = sorted(imp.transform(df).collect(), key=lambda r: (r.s is None, r.s or 0, r.r))
    assert [r.r for r in rows] == [5.0, 5.0, 4.0, 6.0, 5.0]
    assert [r.r_is_missing for r in rows] == [1, 1, 0, 0, 1]


def test_ratio_with_minus_one_stars_is_null(spark):
    df = spark.createDataFrame([(8.0, -1.0), (8.0, 3.0)], "avgRating double, starRating double")
    assert [r[0] for r in df.select(N.expectation_ratio()).collect()] == [None, 2.0]


def test_event_bounds_are_midnights(spark):
    rows = [(dt.datetime(2024, 2, 14, 15, 0),), (dt.datetime(2024, 2, 9, 0, 0),), (dt.datetime(2024, 2, 14, 0, 0),)]
    df = spark.createDataFrame(rows, "date_ci timestamp_ntz")
    got = [r.is_carnaval_2024 for r in TM.event_flags(df).collect()]
    assert got == [0, 1, 1]


def test_iso_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12),), (dt.datetime(2024, 1, 8, 0),)], "d timestamp_ntz")
    assert [r[0] for r in df.select(TM.iso_weekday("d")).collect()] == [7, 1]


def test_one_hot_unseen_and_drop_first(spark):
    tr = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    te = spark.createDataFrame([("b",), ("z",), ("c",)], "c string")
    oh = T.OneHot(["c"], drop_first=True).fit(tr)
    assert oh.output_columns() == ["c_b", "c_c"]
    got = [(r.c_b, r.c_c) for r in oh.transform(te).collect()]
    assert got == [(1, 0), (0, 0), (0, 1)]


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "x string, y string")
    r = R.modes(df, ["x", "y"]).first()
    assert (r.x, r.y) == ("a", "Missing")


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 9, 3, 7, 2, 8, 4, 6, 10]], "v double")
    r = R.distance_summary(df, "v", 0.9, "nearest").first()
    assert (r.median, r.min, r.p90) == (5.5, 1.0, 9.0)


def test_route_rules_null_safe(spark):
    df = spark.createDataFrame([(None, 400.0, None), (None, None, None), (float(1), 100.0, 3.0), (4.5, 10.0, 1.0)],
                               "starRating double, numberOfRooms double, total_amenities double")
    got = [r[0] for r in df.select(RU.route_rules()).collect()]
    assert got == [RU.SEG_LUXURY, RU.SEG_STANDARD, RU.SEG_BOUTIQUE, RU.SEG_LUXURY]


def test_sanitize(spark):
    df = spark.createDataFrame([(1e39,), (None,), (2e9,), (-5.0,)], "x double")
    got = [r[0] for r in df.select(N.sanitize("x")).collect()]
    assert got == [0.0, 0.0, 1e9, -5.0]
    z = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "a double, b double")
    r = z.select(N.psym("div", "a", "b").alias("d"), N.psym("log", "a").alias("l")).collect()
    assert (r[0].d, r[1].l) == (1.0, 0.0)


def test_session_split_disjoint(spark):
    s = R.session_split(D.searches(spark, SF_SMALL))
    per = s.groupBy("searchid").agg(F.count_distinct("split").alias("n")).filter("n > 1").count()
    assert per == 0
    sizes = {r.split: r.c for r in s.groupBy("split").agg(F.count_distinct("searchid").alias("c")).collect()}
    tot = sum(sizes.values())
    assert 0.6 < sizes["train"] / tot < 0.8 and 0.08 < sizes["val"] / tot < 0.22


def test_fan_out_preserved(spark):
    s = D.searches(spark, SF_SMALL)
    n = R.require(s, ["hid", "longitude", "latitude"]).count()
    out = DS.build_dataset(s, D.amenities(spark, SF_SMALL), mca_dims=2)
    assert out.count() == n


def test_whole_build_has_every_part(spark):
    q = __import__("__spark_entry__").queries()
    out = q["j4_whole_build"](spark, SF_SMALL).cache()
    assert out.count() == R.require(D.searches(spark, SF_SMALL), ["hid", "longitude", "latitude"]).count()
    cols = [f"mca_dim_{d}" for d in range(1, 9)]
    rio = R.filter_eq(D.amenities(spark, SF_SMALL), "destination_name", "Rio de Janeiro")   # t7 fits on all destinations
    train = out.filter("split = 'train'").select(F.col("hid").alias("hotel_id")).distinct()
    axes = MCA(D.AMENITY_COLS, k=8).fit(R.semi(rio, train, "hotel_id"))
    mca = {r["hotel_id"]: [r[c] for c in cols] for r in axes.transform(rio).collect()}
    area = {}
    for r in q["j9_nearest_area"](spark, SF_SMALL).collect():
        area.setdefault(r["hid"], set()).add((r["dist_favela_m"], r["favela_cercana_size"], r["favela_vulnerabilidad_salud"]))
    pts = [(p["point_id"] % 2, p["lat"], p["lon"]) for p in D.points(spark, SF_SMALL).collect()]
    rows = out.collect()
    assert len({r["dist_favela_m"] for r in rows}) > 1 and any(r["mca_dim_8"] for r in rows)
    for r in rows:
        got = [r[c] for c in cols]
        if r["hid"] in mca:
            assert np.allclose(np.abs(got), np.abs(mca[r["hid"]]), atol=1e-5)
        else:                                                 # no amenity row at the destination
            assert got == [None] * 8
        assert (r["dist_favela_m"], r["favela_cercana_size"], r["favela_vulnerabilidad_salud"]) in area[r["hid"]]
    for r in rows[::97]:
        for odd, c in ((0, "dist_metro_m"), (1, "dist_playa_m")):
            la, lo = np.radians([p[1] for p in pts if p[0] == odd]), np.radians([p[2] for p in pts if p[0] == odd])
            a, b = np.radians(r["latitude"]), np.radians(r["longitude"])
            h = np.sin((la - a) / 2) ** 2 + np.cos(a) * np.cos(la) * np.sin((lo - b) / 2) ** 2
            assert abs(r[c] / (2 * np.arcsin(np.sqrt(h)).min()) / 6371000 - 1) < 2e-3


def test_features_do_not_leak_val_test_prices(spark):
    s = R.session_split(D.searches(spark, SF_SMALL))
    bumped = s.withColumn("price_by_night_person", F.when(F.col("split") == "train", F.col("price_by_night_person"))
                          .otherwise(F.col("price_by_night_person") * 10)).drop("split")
    cols = ["searchid", "position", "hid", "sid", "precio_mean_5nn", "dist_mean_20nn", "density_kde", "avgRating", "mca_dim_1"]
    a = DS.build_dataset(s.drop("split"), D.amenities(spark, SF_SMALL), mca_dims=2).select(*cols)
    b = DS.build_dataset(bumped, D.amenities(spark, SF_SMALL), mca_dims=2).select(*cols)
    assert a.exceptAll(b).count() == 0


def test_mca_matches_numpy_svd(spark):
    rng = np.random.default_rng(0)
    z = (rng.random((300, 6)) < np.array([0.2, 0.4, 0.5, 0.6, 0.7, 0.9])).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], ", ".join(f"a{i} double" for i in range(6)))
    mca = MCA([f"a{i}" for i in range(6)], k=3).fit(df)
    got = np.array([[r[f"mca_dim_{d}"] for d in (1, 2, 3)] for r in mca.transform(df).collect()])
    # reference: CA of the indicator matrix by SVD of the standardized residuals
    ind = np.hstack([np.stack([1 - z[:, j], z[:, j]], axis=1) for j in range(6)])
    P = ind / ind.sum()
    r, c = P.sum(axis=1), P.sum(axis=0)
    S = (P - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    U, sig, Vt = np.linalg.svd(S, full_matrices=False)
    F_ref = (U[:, :3] * sig[:3]) / np.sqrt(r)[:, None]
    for d in range(3):
        a, b = got[:, d], F_ref[:, d]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_exact_session_split_sizes(spark):
    s = R.session_split_exact(D.searches(spark, SF_SMALL))
    sizes = {r.split: r.c for r in s.groupBy("split").agg(F.count_distinct("searchid").alias("c")).collect()}
    n = sum(sizes.values())
    assert sizes["train"] == n * 70 // 100 and sizes["val"] == n * 15 // 100
    assert s.groupBy("searchid").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0


def test_knn_needs_21_train_hotels(spark):
    from tarifa.operators import spatial as SP
    t = spark.createDataFrame([(i, -43.2 + i * 1e-3, -22.9, 10.0) for i in range(20)],
                              "hid long, longitude double, latitude double, precio_mediano double")
    with pytest.raises(ValueError):
        SP.knn_features(t.select("hid", "longitude", "latitude"), t)


def test_colocated_train_and_non_train_hotel(spark):
    from tarifa.operators import spatial as SP
    t = spark.createDataFrame([(i, -43.2 + i * 1e-3, -22.9, float(i)) for i in range(30)],
                              "hid long, longitude double, latitude double, precio_mediano double")
    q = spark.createDataFrame([(100, -43.2, -22.9)], "hid long, longitude double, latitude double")
    r = SP.knn_features(q, t).first()
    # a non-train hotel on a train hotel's spot also loses that first neighbour (reference rule)
    assert r.precio_mean_5nn == pytest.approx(np.mean([1, 2, 3, 4, 5]))


def test_hotel_with_two_coordinates_keeps_rows(spark):
    s = D.searches(spark, SF_SMALL)
    hid = s.groupBy("hid").count().orderBy(F.desc("count"), "hid").first().hid
    moved = s.withColumn("longitude", F.when((F.col("hid") == hid) & (F.col("position") % 2 == 0),
                                             F.col("longitude") + 0.01).otherwise(F.col("longitude")))
    n = R.require(moved, ["hid", "longitude", "latitude"]).count()
    out = DS.build_dataset(moved, D.amenities(spark, SF_SMALL), mca_dims=0)
    assert out.count() == n


def test_params_without_loss_rejected():
    from tarifa.operators.boosting import spec_from_params
    with pytest.raises(ValueError):
        spec_from_params({"n_estimators": 300, "learning_rate": 0.05, "max_depth": 5})
    s = spec_from_params({"objective": "tweedie", "tweedie_variance_power": 1.4, "n_estimators": 30})
    assert s.family == "tweedie" and s.params["power"] == 1.4


def test_segment_only_in_test_uses_global_expert(spark):
    from tarifa.operators.boosting import ExpertSpec, fit_expert, predict_segments_multi
    tr = spark.createDataFrame([(float(i % 7), float(i), "A" if i % 2 else "B") for i in range(200)],
                               "a double, y double, seg string")
    te = spark.createDataFrame([(1.0, "C"), (2.0, "A")], "a double, seg string")
    glob = fit_expert(tr, ["a"], "y", ExpertSpec("gbt", {"rounds": 2, "depth": 2}))
    loc = {"A": fit_expert(tr.filter("seg = 'A'"), ["a"], "y", ExpertSpec("gbt", {"rounds": 2, "depth": 2}))}
    out = {r.seg: r.p for r in predict_segments_multi(te, "seg", {"p": loc}, glob).collect()}
    g = {r.a: r.p for r in glob.transform(te, "p").collect()}
    assert out["C"] == g[1.0]


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "hid long, longitude double, latitude double, price_by_night_person double")
    assert R.hotel_medians(empty).count() == 0
    assert R.regression_metrics(empty.withColumn("p", F.lit(1.0)), "price_by_night_person", ["p"]).count() == 0
    one = spark.createDataFrame([(1, -43.2, -22.9, 10.0)], "hid long, longitude double, latitude double, price_by_night_person double")
    assert R.hotel_medians(one).first().precio_mediano == 10.0
    from tarifa.operators import spatial as SP
    with pytest.raises(ValueError):
        SP.kde2d(one, "hid", "longitude", "latitude")
    nn = SP.nearest_k(one, "hid", "longitude", "latitude", empty.select(F.col("longitude").alias("x"), F.col("latitude").alias("y")),
                      "x", "y", k=1)
    assert nn.first().nn == []


def test_reference_points_file_or_fallback(spark, tmp_path):
    from tarifa.operators.spatial import FALLBACK_METRO
    from tarifa.sources.formats import reference_points
    assert reference_points(spark, str(tmp_path / "missing.csv"), FALLBACK_METRO).count() == 5
    p = tmp_path / "metro.csv"
    p.write_text("lat,lon\n-22.9,-43.2\n,-43.1\n-22.8,-43.3\n")
    assert reference_points(spark, str(p), FALLBACK_METRO).count() == 2


def test_nulls_in_metrics_gram_and_segments(spark):
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    from tarifa.operators import linear as LIN, relational as R
    from tarifa.operators.boosting import ExpertSpec, fit_expert, fit_segment_experts, predict_segments, predict_segments_multi
    d = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 4.0), (9.0, None)], "y double, p double")
    m = R.regression_metrics(d, "y", ["p"]).first()
    assert (m["n"], m["mae"], m["r2"]) == (2, 0.5, 0.5)
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)] + [(None, 70.0), (3.0, None)], "x double, y double")
    w = LIN.ols(line, ["x"], "y")
    assert abs(w.coef[0] - 2) < 1e-9 and abs(w.intercept) < 1e-9
    s = spark.createDataFrame([("a" if i % 2 else "b", float(i % 7), float(i % 5)) for i in range(200)], "seg string, x double, y double")
    models = fit_segment_experts(s, "seg", ["x"], "y", ExpertSpec("gbt", {"rounds": 2, "depth": 2}))
    odd = spark.createDataFrame([("a", 1.0, 1.0), (None, 2.0, 1.0), ("new", 3.0, 1.0)], "seg string, x double, y double")
    glob = fit_expert(s, ["x"], "y", ExpertSpec("gbt", {"rounds": 2, "depth": 2}))
    assert predict_segments(odd, "seg", models, "p", glob).filter(F.col("p").isNotNull()).count() == 3
    assert predict_segments_multi(odd, "seg", {"p": models}, glob).filter(F.col("p").isNotNull()).count() == 3
    with pytest.raises(PySparkException, match="no expert for segment"):
        predict_segments(odd, "seg", models, "p").collect()


def test_mae_expert_fits_the_median(spark):
    from tarifa.operators.boosting import ExpertSpec, fit_expert
    d = spark.createDataFrame([(1.0, 100.0 if i % 10 < 8 else 1000.0) for i in range(1000)], "x double, y double")
    m = fit_expert(d, ["x"], "y", ExpertSpec("mae", {"rounds": 3, "depth": 3}))
    assert abs(m.transform(d.limit(1), "p").first()["p"] - 100.0) < 1e-6
    step = spark.createDataFrame([(float(i % 2), float((i % 2) * 500 + (i % 7) + (3000 if i % 10 == 0 else 0))) for i in range(2000)], "x double, y double")
    m = fit_expert(step, ["x"], "y", ExpertSpec("mae", {"rounds": 40, "depth": 2, "step": 0.3}))
    got = {r["x"]: r["p"] for r in m.transform(step, "p").select("x", "p").distinct().collect()}
    assert abs(got[1.0] - 503) < 3 and abs(got[0.0] - 4) < 3


def test_many_categories_fit(spark):
    from tarifa.operators.boosting import ExpertSpec, fit_expert
    from tarifa.operators.transformers import CategoryIndexer
    d = spark.createDataFrame([(f"c{i % 40:02d}", float(i % 40)) for i in range(800)], "c string, y double")
    ci = CategoryIndexer(["c"]).fit(d)
    t = ci.transform(d)
    for family in ("gbt", "rf", "tweedie", "mae"):
        assert fit_expert(t, ci.output_columns(), "y", ExpertSpec(family, {} if family == "rf" else {"rounds": 2})).transform(t, "p").count() == 800


def test_nearest_across_the_date_line(spark):
    from tarifa.operators import spatial as SP
    q = spark.createDataFrame([(i, 179.999 - i * 0.01, 0.0) for i in range(50)] + [(99, -179.999, 0.0)], "qid long, x double, y double")
    rows = [(i, -179.999 + i * 0.01, 0.0) for i in range(50)] + [(100 + i, -100.0 + i * 0.001, 40.0) for i in range(400)]
    p = spark.createDataFrame(rows, "pid long, x double, y double")
    exact = {r["qid"]: r["nn"][0]["d"] for r in SP.nearest_k(q, "qid", "x", "y", p, "x", "y", k=1, tie="pid", metric="haversine", small_points=10**9, chunk=10**6).collect()}
    before = spark.conf.get(SP.ARROW_ROWS)
    grid = {r["qid"]: r["nn"][0]["d"] for r in SP.nearest_k(q, "qid", "x", "y", p, "x", "y", k=1, tie="pid", metric="haversine", small_points=0, chunk=16).collect()}
    assert grid == exact and grid[0] < 300 and spark.conf.get(SP.ARROW_ROWS) == before


def test_quantiles_with_infinities(spark):
    import math
    from tarifa.operators.quantiles import exact_quantiles, nearest_rank
    v = [-math.inf] * 5 + [float(i) for i in range(300)] + [math.inf] * 5 + [math.nan] * 3
    d = spark.createDataFrame([(x,) for x in v], "v double")
    got = exact_quantiles(d, "v", [0.0, 0.5, 1.0], bins=8, collect_limit=10)
    assert got[0.0] == -math.inf and got[1.0] == math.inf and got[0.5] == 149.5
    assert nearest_rank(d, "v", 0.5, bins=8, collect_limit=10) in (149.0, 150.0)
    close = spark.createDataFrame([(1.0 + k * 2.0**-52,) for k in range(4) for _ in range(50)], "v double")
    assert exact_quantiles(close, "v", [0.0, 0.3], bins=8, collect_limit=10)[0.3] == 1.0 + 2.0**-52


def test_sample_n_by_threshold(spark):
    from tarifa.operators import relational as R
    d = spark.range(30_000).withColumnRenamed("id", "k")
    top = {r["k"] for r in R.sample_n(d, 9_000, "k").collect()}
    more = {r["k"] for r in R.sample_n(d, 12_345, "k").collect()}
    assert len(top) == 9_000 and len(more) == 12_345 and top <= more
    assert R.sample_n(d, 30_001, "k").count() == 30_000


def test_all_rounds_of_the_search_space():
    from tarifa.operators import tuning as TU
    assert {TU.to_spec(c).params["rounds"] for c in TU.random_configs(300)} == {n for _, n in TU.LR_ROUNDS}
