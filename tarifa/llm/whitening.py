"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

A is the matrix of the distinct scaled vectors, each column less its mean. Starting from a unit vector v1, the
recurrences  alpha_j u_j = A v_j - beta_(j-1) u_(j-1)  and  beta_j v_(j+1) = A' u_j - alpha_j v_j  give A V = U B with
a small upper bidiagonal B, whose singular values are those of A and whose right singular vectors, turned by V, are
the components. All u and all v are reorthogonalised fully.

Only rows are distributed. Every u_j is A z_j for a short vector z_j that the driver keeps, so no u is ever stored: a pass
over the rows forms p = A w and U = A Z block by block and adds up p'p, U'p and A'p, which is all that one step needs.
A pass depends on the driver's short vectors and the checkpointed rows alone; a lost executor costs a repeated task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import extent, matrix, packed_type, scaled

FACTOR = 64
OFFSET = 1_000_000
COMPONENTS = 16
MOST = 1 << 40          # scaled entries are held within this
BLOCK = 4096            # vectors of a block
TASK_BYTES = 1 << 26    # of doubles a task of a pass forms
TINY = 1e-9             # singular values below this part of the largest count as zero
FAN_IN = 512            # partial sums that are added up in one place


def _blocks(df: DataFrame, vec_col: str, width: int, kind: str) -> DataFrame:
    """The distinct scaled vectors, in blocks of at most BLOCK: (n, rows)."""
    def scale(batches):
        for b in batches:
            _, m = matrix(b.column(0), width)
            x = np.unique(scaled(m, FACTOR, MOST).astype(kind), axis=0)     # repeats of a batch go before the shuffle
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    def pack(batches):
        held = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    def block(rows):
        return pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64()), "rows": pa.array([b"".join(rows)], pa.binary())})

    return df.select(vec_col).mapInArrow(scale, "x binary").distinct().mapInArrow(pack, "n long, rows binary")


def _added(df: DataFrame, make, length: int) -> np.ndarray:
    """The sum over all blocks of make(block), vectors of doubles: one partial sum a task, added up in a second step when
    there are many tasks, so that the driver receives few."""
    def run(batches):
        total = np.zeros(length)
        for b in batches:
            for rows in b.column(0).to_pylist():
                total += make(rows)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    def add(batches):
        total = np.zeros(length)
        for b in batches:
            for s in b.column(0).to_pylist():
                total += s
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = df.rdd.getNumPartitions()
    sums = df.select("rows").mapInArrow(run, "s array<double>")
    if parts > FAN_IN:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(add, "s array<double>")
    return np.sum([r["s"] for r in sums.collect()], axis=0) if length else np.zeros(0)


class _Rows:
    """The centred rows, as products with short matrices."""

    def __init__(self, blocks: DataFrame, n: int, sums: list, width: int, kind: str):
        self.blocks, self.width, self.kind = blocks, width, kind
        self.whole = np.array([s // n for s in sums], np.int64)                         # the mean, cut into an integer
        self.rest = np.array([(s % n) / n for s in sums])                              # and what is left of it

    def centre(self):
        whole, rest, kind, width = self.whole, self.rest, self.kind, self.width
        return lambda rows: (np.frombuffer(rows, kind).reshape(-1, width).astype(np.int64) - whole) - rest

    def step(self, w: np.ndarray, z: np.ndarray):
        """For p = A w and U = A Z: p'p, U'p, A'p."""
        d, k, centre = self.width, z.shape[1], self.centre()
        shared = self.blocks.sparkSession.sparkContext.broadcast(np.column_stack([w, z]))

        def make(rows):
            a = centre(rows)
            q = a @ shared.value
            return np.concatenate([q.T @ q[:, 0], a.T @ q[:, 0]])

        got = _added(self.blocks, make, 1 + k + d)
        shared.unpersist()
        return got[0], got[1:1 + k], got[1 + k:]

    def gram(self, c: np.ndarray):
        """For Y = A c: (the sums of Y, Y'Y, the sum of squares of A)."""
        k, centre = c.shape[1], self.centre()

        def make(rows):
            a = centre(rows)
            y = a @ c
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel(), [(a * a).sum()]])

        got = _added(self.blocks, make, k + k * k + 1)
        return got[:k], got[k:k + k * k].reshape(k, k), got[-1]


def _away(v: list, width: int, rng) -> np.ndarray:
    """A random unit vector orthogonal to ``v``."""
    x = rng.standard_normal(width)
    for _ in range(3):
        for u in v:
            x -= (u @ x) * u
        x /= np.linalg.norm(x)
    return x


def bidiagonalise(step, width: int, steps: int | None = None, seed: int = 42):
    """(V, B) with A V = U B, from ``step``: (w, Z) -> p'p, U'p, A'p for p = A w, U = A Z. All ``width`` directions are spanned
    unless ``steps`` says fewer, so repeated singular values are found too: where the recurrence ends early (nothing new
    in A' u, or a direction without variance) it goes on from a random direction orthogonal to all before."""
    rng = np.random.default_rng(seed)
    steps = min(width, steps or width)
    v, z, g, b = [_away([], width, rng)], np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((steps, steps))
    w, scale = v[0].copy(), 0.0
    for j in range(steps):
        for _ in range(3):                             # once is enough unless p lay close to the span of U
            pp, c, atp = step(w, z)
            w, atp, left = w - z @ c, atp - g @ c, pp - c @ c
            if c @ c <= 1e-12 * pp:
                break
        alpha = math.sqrt(max(left, 0.0))
        scale = max(scale, alpha)
        if alpha <= TINY * 1e-2 * scale:               # this direction has no variance of its own: no u belongs to it
            u_z, u_g, alpha = np.zeros(width), np.zeros(width), 0.0
        else:
            u_z, u_g = w / alpha, atp / alpha
        b[j, j] = alpha
        z, g = np.column_stack([z, u_z]), np.column_stack([g, u_g])
        if j + 1 == steps:
            break
        r = u_g - alpha * v[j]
        for _ in range(2):
            for u in v:
                r = r - (u @ r) * u
        beta = float(np.linalg.norm(r))
        scale = max(scale, beta)
        if alpha and beta > 1e-13 * scale:
            b[j, j + 1] = beta
            v.append(r / beta)
            w = v[-1] - beta * u_z
        else:
            v.append(_away(v, width, rng))
            w = v[-1].copy()
    return np.column_stack(v), b


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           steps: int | None = None) -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out; a vector shorter than the longest counts as
    followed by zeros. Entries become x = floor(64 c) + 1 000 000 (64 c is held within 2^40). The fit list is
    each distinct x vector once, ``n`` of them with sums S. Repeated rows and null ids are transformed like any other. ``deviation``
    is the exact sum of (n x - S)^2, null where it does not fit a long. Components with a standard deviation below 1e-9 of
    the largest are left out (a constant column adds none; vectors all alike, empty vectors and empty tables give no rows).
    Extra columns are ignored. ``steps`` below the vector length stops the bidiagonalisation early."""
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    schema = f"`{id_col}` {df.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, width, top = extent(df, "vec", FACTOR, MOST)
    if not rows or not width:
        return spark.createDataFrame([], schema)
    kind = packed_type(top)
    blocks = checkpoint(_blocks(df, "vec", width, kind))
    parts = blocks.rdd.getNumPartitions()
    n = int(blocks.agg(F.sum("n")).first()[0])
    blocks = blocks.coalesce(min(parts, max(spark.sparkContext.defaultParallelism, -(-n * width * 8 // TASK_BYTES))))

    def total(batches):
        own = [0] * width
        for b in batches:
            for r in b.column(0).to_pylist():
                own = [s + int(t) for s, t in zip(own, np.frombuffer(r, kind).reshape(-1, width).sum(axis=0, dtype=np.int64), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "s": pa.array([str(s) for s in own], pa.string())})

    got = (blocks.select("rows").mapInArrow(total, "i int, s string").groupBy("i")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())     # exact: sums of longs as decimals
    sums = [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]
    fit = _Rows(blocks, n, sums, width, kind)
    v, b = bidiagonalise(fit.step, width, steps)
    _, s, turn = np.linalg.svd(b)
    keep = [i for i in range(min(components, len(s))) if s[i] > TINY * s[0] and s[i] > 0]
    if not keep:
        return spark.createDataFrame([], schema)
    e = s[keep] ** 2 / n
    to = (v @ turn[keep].T) / np.sqrt(e)
    mean, yy, squares = fit.gram(to)
    mean = mean / n
    error = float(np.abs(yy / n - np.outer(mean, mean) - np.eye(len(keep))).max())
    explained = e / (squares / n)
    exact = width * (2 * n * max(top, 1)) ** 2 < 1 << 63
    shared, whole, rest = spark.sparkContext.broadcast(to), fit.whole, fit.rest

    def project(batches):
        k = len(keep)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                places, m = matrix(part.column(1), width)
                x = scaled(m, FACTOR, MOST)
                if exact:
                    dev = pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1))
                else:
                    dev = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
                    dev = pa.array([a if a < 1 << 63 else None for a in dev], pa.int64())
                y = ((x - whole) - rest) @ shared.value
                each = np.repeat(np.arange(len(places)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                     pa.array(np.full(len(each), n)), dev.take(pa.array(each)), pa.array(y.ravel()),
                     pa.array(np.tile(explained, len(places))), pa.array(np.full(len(each), error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.mapInArrow(project, schema)
