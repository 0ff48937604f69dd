"""Exact interventional Shapley values of packed boosted trees.

The value of a coalition S of features is the mean score of rows that take the features in S from the explained row and
the others from a background row, over all background rows. For one explained row x, one background row z and one
leaf, the features on the way to the leaf fall into those that only x passes (say a of them), those that only z passes
(b), those that both pass, and those that neither does; in the last case no mixture reaches the leaf. Else the leaf,
of value v, gives every feature of the first kind v (a - 1)! b! / (a + b)! and takes a! (b - 1)! / (a + b)! v from
every feature of the second kind.

So a leaf asks one thing of a row: which of its (at most depth) features the row passes, a pattern of bits. The background
enters by the number of its rows with each pattern at each leaf, counted in one distributed pass over all of it, however
many rows it has; each explained row then costs trees x leaves x depth, with no pairs of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .forest import Boosters, PackedForest

ROWS = 1024      # rows of a batch whose patterns are held at once


def leaf_paths(m: Boosters, b: int) -> list:
    """Per leaf of booster ``b``: (value, [(feature, low, high)]), one entry per feature on the way, whose conditions are joined to
    one range: passed if low < x <= high, where a missing value counts as below everything."""
    out = []
    for r in range(int(m.rounds[b])):
        feature, cut, value = m.feature[b, r], m.cut[b, r], m.value[b, r]
        stack = [(0, {})]
        while stack:
            node, way = stack.pop()
            if node >= len(feature) or feature[node] < 0:
                if value[node] != 0.0:
                    out.append((float(value[node]), [(f, *ends) for f, ends in sorted(way.items())]))
                continue
            f, t = int(feature[node]), float(cut[node])
            low, high = way.get(f, (None, np.inf))                       # low None: missing passes too
            stack.append((2 * node + 1, way | {f: (low, min(high, t))}))
            stack.append((2 * node + 2, way | {f: (t if low is None else max(low, t), high)}))
    return out


def _weights(depth: int) -> np.ndarray:
    """(patterns of x, patterns of z, place): what a leaf of value one gives the feature at a place; 2^depth patterns each."""
    size, fact = 1 << depth, [math.factorial(i) for i in range(depth + 1)]
    out = np.zeros((size, size, depth))
    for x in range(size):
        for z in range(size):
            if x | z != size - 1:                                        # a feature that neither passes
                continue
            only_x, only_z = x & ~z, z & ~x
            a, b = only_x.bit_count(), only_z.bit_count()
            for i in range(depth):
                if only_x >> i & 1:
                    out[x, z, i] = fact[a - 1] * fact[b] / fact[a + b]
                elif only_z >> i & 1:
                    out[x, z, i] = -fact[a] * fact[b - 1] / fact[a + b]
    return out


class _Leaves:
    """The leaves of a booster by number of features on the way: arrays (leaves, k) of feature, low, high."""

    def __init__(self, paths):
        self.by = {}
        for k in sorted({len(w) for _, w in paths}):
            own = [(v, w) for v, w in paths if len(w) == k]
            self.by[k] = (np.array([v for v, _ in own]), np.array([[c[0] for c in w] for _, w in own], np.int64).reshape(-1, k),
                          np.array([[-np.inf if c[1] is None else c[1] for c in w] for _, w in own]).reshape(-1, k),
                          np.array([[c[1] is None for c in w] for _, w in own], bool).reshape(-1, k),
                          np.array([[c[2] for c in w] for _, w in own]).reshape(-1, k))

    def patterns(self, x: np.ndarray, k: int) -> np.ndarray:
        """(rows, leaves): bit i is set if the row passes the i-th feature."""
        _, feature, low, open_, high = self.by[k]
        out = np.zeros((len(x), len(feature)), np.int64)
        for i in range(k):
            v = x[:, feature[:, i]]
            gone = np.isnan(v)
            ok = np.where(gone, open_[:, i], (open_[:, i] | (v > low[:, i])) & (v <= high[:, i]))
            out |= ok.astype(np.int64) << i
        return out


def _matrix(batch, at: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(at + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))


def _pattern_counts(background: DataFrame, features, leaves: _Leaves) -> tuple[dict, int]:
    """Rows of the background by pattern, for each leaf (bounded by the model: leaves x 2^depth), and their number."""
    sc = background.sparkSession.sparkContext
    shared, n_x = sc.broadcast(leaves), len(features)
    d = background.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def run(batches):
        own, counts, rows = shared.value, None, 0
        counts = {k: np.zeros((len(v[0]), 1 << k), np.int64) for k, v in own.by.items()}
        for batch in batches:
            x = _matrix(batch, 0, n_x)
            rows += len(x)
            for at in range(0, len(x), ROWS):
                for k, c in counts.items():
                    p = own.patterns(x[at:at + ROWS], k) + (np.arange(len(c)) << k)
                    c += np.bincount(p.ravel(), minlength=c.size).reshape(c.shape)
        flat = np.concatenate([[rows], *[c.ravel() for c in counts.values()]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at].astype(np.int64))], names=["i", "n"])

    got = d.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(1 + sum(len(v[0]) << k for k, v in leaves.by.items()), np.int64)
    flat[got["i"].to_numpy()] = got["n"].to_numpy()
    out, at = {}, 1
    for k, v in leaves.by.items():
        out[k] = flat[at:at + (len(v[0]) << k)].reshape(-1, 1 << k)
        at += len(v[0]) << k
    return out, int(flat[0])


def shapley_values(df: DataFrame, forest: PackedForest, slot: str, keys, background: DataFrame, group: str = "") -> DataFrame:
    """``(keys.., feature, attribution, base_value)`` of the booster ``group`` of ``slot``, on its raw score (log scale for Tweedie): the
    base value is the mean score of the background, and base value + sum of attributions = score of the row.

    NULL and NaN features are missing values, as in the model. An empty background raises ValueError."""
    m = forest.slots[slot]
    b = m.groups.index(group)
    leaves = _Leaves(leaf_paths(m, b))
    counts, n = _pattern_counts(background, forest.features, leaves)
    if not n:
        raise ValueError("the background has no rows")
    base, tables = float(m.f0[b]), {}
    for k, c in counts.items():
        share, value = c / n, leaves.by[k][0]
        base += float(value @ share[:, -1])                              # background rows that reach the leaf
        if k:
            tables[k] = np.einsum("lz,xzi,l->lxi", share, _weights(k), value)
    keys, feats, sc = list(keys), list(forest.features), df.sparkSession.sparkContext
    shared = sc.broadcast((leaves, tables))
    n_k, n_x = len(keys), len(feats)
    d = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    types = [d.schema[f"k{i}"].dataType for i in range(n_k)]

    def run(batches):
        own, table = shared.value
        for batch in batches:
            x = _matrix(batch, n_k, n_x)
            phi = np.zeros((len(x), n_x))
            for at in range(0, len(x), ROWS):
                part = x[at:at + ROWS]
                rows = np.arange(len(part))[:, None] * n_x
                total = np.zeros(len(part) * n_x)
                for k, t in table.items():
                    p = own.patterns(part, k)
                    got = t[np.arange(p.shape[1])[None, :], p]            # (rows, leaves, places)
                    for i in range(k):
                        total += np.bincount((rows + own.by[k][1][:, i][None, :]).ravel(), got[:, :, i].ravel(), len(total))
                phi[at:at + ROWS] = total.reshape(len(part), n_x)
            each = np.repeat(np.arange(len(x)), n_x)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(each)) for i in range(n_k)], pa.array(np.tile(feats, len(x)).tolist(), pa.string()), pa.array(phi.ravel()),
                 pa.array(np.full(len(each), base))], names=[*keys, "feature", "attribution", "base_value"])

    schema = StructType([*[StructField(c, t) for c, t in zip(keys, types, strict=True)], StructField("feature", StringType()),
                         StructField("attribution", DoubleType()), StructField("base_value", DoubleType())])
    return d.mapInArrow(run, schema)
