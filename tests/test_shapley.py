"""Shapley values of packed trees against all feature subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import forest as FO
from tarifa.operators import shapley as SH
from test_forest import frame, rows


def brute(score, x, z):
    """Shapley values of one row by the definition: every subset of features, every background row."""
    n = len(x)
    value = {}
    for s in itertools.product((0, 1), repeat=n):
        mixed = np.where(np.array(s, bool), x, z)
        value[s] = float(score(mixed).mean())
    out = []
    for i in range(n):
        total = 0.0
        for s in itertools.product((0, 1), repeat=n):
            if not s[i]:
                k = sum(s)
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                total += w * (value[(*s[:i], 1, *s[i + 1:])] - value[s])
        out.append(total)
    return out, value[(0,) * n]


@pytest.mark.parametrize("loss", ["tweedie", "absolute"])
def test_equal_to_subset_enumeration(spark, monkeypatch, loss):
    monkeypatch.setattr(SH, "ROWS", 7)
    x, y, seg, fold = rows(300, 5)
    df = frame(spark, x, y, seg, fold).withColumn("d", F.lit(0.5) * F.col("fold") + F.col("c"))
    feats = ["a", "b", "c", "d"]
    x4 = np.column_stack([x, 0.5 * fold + x[:, 2]])
    m = FO.grow(df, feats, "y", [FO.Slot("s", FO.Family(loss, rounds=8, depth=4, step=0.3, min_rows=5), F.col("seg"))], bins=24)
    back = df.where("id % 3 = 0")
    got = SH.shapley_values(df.where("id < 25"), m, "s", ["id"], back, "s1").collect()
    b, z = m.slots["s"].groups.index("s1"), x4[::3]
    by = {(r["id"], r["feature"]): r["attribution"] for r in got}
    assert len(got) == len(by) == 25 * 4
    for i in range(25):
        want, base = brute(lambda t: m.slots["s"].raw(t, b), x4[i], z)
        assert np.allclose([by[i, f] for f in feats], want, atol=1e-9)
        assert abs(got[0]["base_value"] - base) < 1e-9
        assert abs(sum(by[i, f] for f in feats) + base - m.slots["s"].raw(x4[i:i + 1], b)[0]) < 1e-9


def test_model_without_splits_and_empty_inputs(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(50)], "id long, a double, y double")
    m = FO.grow(df, ["a"], "y", [FO.Slot("s", FO.Family("squared", rounds=2, depth=2))])
    got = SH.shapley_values(df.limit(3), m, "s", ["id"], df).collect()
    assert [r["attribution"] for r in got] == [0.0] * 3 and all(abs(r["base_value"] - 2.0) < 1e-9 for r in got)
    assert SH.shapley_values(df.where("false"), m, "s", ["id"], df).count() == 0
    with pytest.raises(ValueError):
        SH.shapley_values(df, m, "s", ["id"], df.where("false"))
