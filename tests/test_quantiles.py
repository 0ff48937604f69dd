import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators.quantiles import column_quantiles, exact_median_values, exact_quantiles, nearest_rank


@pytest.mark.parametrize("n,dup", [(1, False), (2, False), (1001, False), (5000, True)])
def test_exact_quantiles_match_numpy(spark, n, dup):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 7, n).astype(float) if dup else rng.lognormal(3, 1, n)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = exact_quantiles(df, "v", [0.5, 0.1, 0.9, 0.0, 1.0], bins=8, collect_limit=50)
    for q, x in got.items():
        assert x == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)
    assert nearest_rank(df, "v", 0.9, bins=8, collect_limit=50) == np.sort(v)[int(np.floor(0.9 * (n - 1) + 0.5))]


QS = [0.0, 0.1, 0.5, 0.75, 1.0]


def _columns(n=4000):
    rng = np.random.default_rng(5)
    return {"spread": rng.lognormal(0, 8, n), "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5),
            "third": np.where(rng.random(n) < 1 / 3, 7.0, rng.normal(size=n)), "near": 1.0 + rng.integers(0, 5, n) * 2.0 ** -52,
            "wide": rng.choice([-1e308, 0.0, 5e-324, 1e308], n), "a.b": rng.normal(1e9, 1, n)}


@pytest.mark.parametrize("limit", [0, 30, 100_000])
def test_all_columns_in_the_same_passes_match_numpy(spark, limit):
    data = _columns()
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())] + [(None,) * len(data), (math.nan,) * len(data)],
                               ", ".join(f"`{c}` double" for c in data))
    got = column_quantiles(df, {c: QS for c in data}, bins=16, collect_limit=limit)
    for c, v in data.items():
        s = np.sort(v)
        for q in QS:
            pos = q * (len(v) - 1)
            lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
            assert got[c][q] == pytest.approx(lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos)), rel=1e-15), (c, q)


def test_columns_of_infinities_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(math.inf, None, -math.inf), (math.inf, None, 1.0), (1.0, math.nan, math.inf)], "a double, b double, c double")
    assert column_quantiles(df, {"a": [0.0, 0.5], "b": [0.5], "c": [0.0, 0.5, 1.0]}) == {
        "a": {0.0: 1.0, 0.5: math.inf}, "b": {0.5: None}, "c": {0.0: -math.inf, 0.5: 1.0, 1.0: math.inf}}
    assert exact_median_values(df.limit(0), ["a", "c"]) == {"a": None, "c": None}
    assert exact_median_values(df, []) == {}


def test_passes_do_not_grow_with_the_columns(spark):
    sc, jobs = spark.sparkContext, {}
    df = spark.range(20000).select(*[(F.rand(i) * 10 ** i).alias(f"c{i}") for i in range(12)])
    for n in (1, 12):
        sc.setJobGroup(f"columns-{n}", "quantile passes")
        exact_median_values(df, [f"c{i}" for i in range(n)], bins=64, collect_limit=100)
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"columns-{n}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[12] <= 2 * jobs[1]
