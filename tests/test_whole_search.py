"""Searches run at the reference's sizes, not at reduced ones."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tarifa.operators import symbolic as SY


class Stop(Exception):
    """Ends a query before its work."""


def test_symbolic_query_searches_a_thousand_formulas(spark, monkeypatch):
    seen = []

    def fit(self, df, y):
        seen.append((self.population, self.generations, self.sample))
        raise Stop

    monkeypatch.setattr(SY.SymbolicFeatures, "fit", fit)
    with pytest.raises(Stop):
        E.queries()["t12_symbolic_features"](spark, SF_SMALL)
    assert seen == [(1000, 15, None)]


def test_symbolic_scores_of_a_generation_take_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(300).selectExpr("cast(id % 11 as double) as a", "cast(id % 7 as double) - 3 as b",
                                    "if(id % 10 = 0, null, cast(id % 11 + id % 5 as double)) as y").repartition(3).transform(lambda d: d.checkpoint())
    sym = SY.SymbolicFeatures(["a", "b"])
    sym.medians = {"a": 0.0, "b": 0.0}
    trees = ["a", ("sub", "a", "a"), ("mul", "a", "b"), ("div", "a", "b"), ("log", "b"), ("sqrt", "b"), ("sin", ("cos", "a")), ("add", "a", ("div", "b", "a"))]
    got = sym._score(sym._filled(d.mapInArrow(count, d.schema)), "y", trees)
    assert seen.value == 300
    v = sym._values(d.where("y is not null"), "y", trees)
    want = v.agg(*[F.try_divide(F.covar_pop(f"_v{i}", "_y"), F.stddev_pop(f"_v{i}") * F.stddev_pop("_y")) for i in range(len(trees))]).first()
    assert max(abs(abs(w or 0.0) - g) for g, w in zip(got, want, strict=True)) < 1e-6


def test_scores_of_all_parts_are_computed_side_by_side(spark):
    from tarifa.operators import evolution as EV
    d = spark.range(4000).selectExpr("cast(id % 11 as double) as a", "cast(id % 7 as double) as y").repartition(8).transform(lambda d: d.checkpoint())
    sc = spark.sparkContext
    sc.setJobGroup("side-by-side", "one job, not one for each part")
    try:
        EV.correlations(d, ["a"], "y", ["a", ("sin", "a")])
        assert len(sc.statusTracker().getJobIdsForGroup("side-by-side")) <= 2
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def _stop_with(seen):
    def stop(*args, **more):
        seen.append((args, more))
        raise Stop
    return stop


def test_halving_query_searches_three_hundred_configurations(spark, monkeypatch):
    from tarifa.operators import tuning as TU
    seen = []
    monkeypatch.setattr(TU, "cv_scores", _stop_with(seen))
    with pytest.raises(Stop):
        E.queries()["m16_successive_halving"](spark, SF_SMALL)
    sample, _, _, configs, k, cap = seen[0][0]
    assert len(configs) == 300 and sample.count() == 4000 and k == 3 and cap is None
    assert {TU.to_family(c, cap).rounds for c in configs} == {n for _, n in TU.LR_ROUNDS}


def test_random_search_query_runs_fifteen_patient_trials(spark, monkeypatch):
    from tarifa.operators import forest as FO
    seen = []
    monkeypatch.setattr(FO, "grow", _stop_with(seen))
    with pytest.raises(Stop):
        E.queries()["m18_random_search"](spark, SF_SMALL)
    args, more = seen[0]
    rounds = [s.family.rounds for s in args[3]]
    assert len(rounds) == 15 and min(rounds) >= 200 and max(rounds) > 1000 and more["patience"] == 20


def _data(spark, n=900, parts=3):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (n, 3)).astype(float)
    y = 40 + 30 * (x[:, 0] > 12) + 2 * x[:, 1] + rng.gamma(2.0, 3.0, n)
    return spark.createDataFrame([(i, *map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                                 "id long, a double, b double, c double, y double, fold int").repartition(parts, "id")


def test_folds_are_judged_alike_in_one_task_and_spread(spark, monkeypatch):
    from tarifa.operators import forest as FO
    from tarifa.operators import tuning as TU
    d = _data(spark)
    configs = [c | {"subsample": 1.0, "min_child_samples": 5} for c in TU.random_configs(4)]
    here = TU.cv_scores(d, ["a", "b", "c"], "y", configs, 3, 12)
    again = TU.cv_scores(d.repartition(5), ["a", "b", "c"], "y", configs, 3, 12)
    assert all(abs(a["rmse"] - b["rmse"]) < 1e-6 for a, b in zip(here, again, strict=True))
    monkeypatch.setattr(FO, "LOCAL_BYTES", 0)
    spread = TU.cv_scores(d, ["a", "b", "c"], "y", configs, 3, 12)
    for a, b in zip(here, spread, strict=True):
        assert all(abs(a[k] - b[k]) <= 0.03 * max(1.0, abs(a[k])) for k in a), (here, spread)      # the bins are those of all rows and of a fold's rows


def test_row_and_column_samples_and_penalties_count(spark):
    import numpy as np
    from tarifa.operators import forest as FO
    d = _data(spark)
    fams = {"plain": FO.Family("squared", rounds=12, depth=3, step=0.3), "rows": FO.Family("squared", rounds=12, depth=3, step=0.3, subsample=0.6),
            "cols": FO.Family("squared", rounds=12, depth=3, step=0.3, colsample=0.3), "stiff": FO.Family("squared", rounds=12, depth=3, step=0.3, reg_alpha=1e9),
            "least": FO.Family("squared", rounds=12, depth=3, step=0.3, min_gain=1e9)}
    m = FO.grow(d, ["a", "b", "c"], "y", [FO.Slot(n, f) for n, f in fams.items()]).slots
    assert not np.array_equal(m["plain"].feature, m["rows"].feature) or not np.allclose(m["plain"].value, m["rows"].value)
    for tree in m["cols"].feature[0]:
        assert len(set(tree[tree >= 0].tolist())) <= 1                      # one of three features for a tree
    assert len(set(m["cols"].feature[m["cols"].feature >= 0].tolist())) > 1
    assert (m["stiff"].value == 0).all() and (m["least"].feature == -1).all()
    again = FO.grow(d, ["a", "b", "c"], "y", [FO.Slot("rows", fams["rows"])]).slots["rows"]
    assert np.array_equal(again.feature, m["rows"].feature)
    with pytest.raises(ValueError):
        FO.Family("absolute", subsample=0.5)


def test_patient_search_keeps_the_best_round(spark):
    from tarifa.operators import tuning as TU
    d = _data(spark)
    got = TU.random_search(spark, d.where("fold > 0"), d.where("fold = 0"), ["a", "b", "c"], "y", n_trials=3, round_cap=60, patience=5).collect()
    assert len(got) == 3 and max(r.r2 for r in got) > 0.7 and all(1 <= r.trees <= 60 for r in got)
