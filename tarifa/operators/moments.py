"""Mergeable centred co-moments: count, means and cross-products around the mean, in one pass.

Each task keeps (n, mean, M) per group, M the sum of (x - mean)(x - mean)', and merges batch after batch and task after
task by  M = M1 + M2 + d d' n1 n2 / (n1 + n2),  d the difference of the means. Nothing is squared before it is centred,
so columns with a large common offset lose no digits. One matrix product a batch replaces an aggregate expression per
pair of columns; a plan stays small with hundreds of columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 256      # task results that are merged in one place


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        c = x - mean
        rest = c.mean(axis=0)                  # what rounding left of the mean
        return cls(float(len(x)), mean + rest, c.T @ c - len(x) * np.outer(rest, rest))

    def __add__(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m2 + other.m2 + np.outer(d, d) * (self.n * other.n / n))


def co_moments(df: DataFrame, columns, by: str | None = None) -> dict:
    """group value (as text; "" without ``by``; None for NULL) -> ``Moments`` of ``columns`` over the rows without a NULL or NaN among them."""
    columns, width = list(columns), len(columns)
    group = F.lit("") if by is None else F.col(by).cast("string")
    d = df.select(group.alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    d = d.dropna(subset=[f"x{i}" for i in range(width)])

    def rows(held):
        got = list(held.items())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([m.n for _, m in got], pa.float64()),
                                           pa.array([m.mean.tobytes() for _, m in got], pa.binary()), pa.array([m.m2.tobytes() for _, m in got], pa.binary())],
                                          names=["g", "n", "mean", "m2"])

    def put(held, key, m):
        held[key] = held[key] + m if key in held else m

    def measure(batches):
        held: dict = {}
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)])
                if by is None:
                    put(held, "", Moments.of(x))
                else:
                    keys = b.column(0).to_pylist()
                    for key in dict.fromkeys(keys):
                        put(held, key, Moments.of(x[[k == key for k in keys]]))
        if held:
            yield rows(held)

    def merge(batches):
        held: dict = {}
        for b in batches:
            for key, m in _read(zip(*[c.to_pylist() for c in b.columns], strict=True), width):
                put(held, key, m)
        if held:
            yield rows(held)

    schema = "g string, n double, mean binary, m2 binary"
    parts = d.mapInArrow(measure, schema)
    n = df.rdd.getNumPartitions()
    if n > FAN_IN:
        parts = parts.repartition(math.isqrt(n)).mapInArrow(merge, schema)
    held: dict = {}
    for key, m in _read(parts.collect(), width):
        put(held, key, m)
    return held


def _read(rows, width: int):
    for key, n, mean, m2 in rows:
        yield key, Moments(n, np.frombuffer(bytes(mean)), np.frombuffer(bytes(m2)).reshape(width, width))
