"""Rows of vectors as matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their entries as doubles). A vector that is null or holds a null or non-finite entry
    is not usable; a shorter vector counts as followed by zeros up to ``width``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    col = col.take(pa.array(at))
    n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)   # nulls become NaN
    if len(n) and width and (n == width).all():
        out = flat.reshape(-1, width)
    else:
        row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        place = np.arange(len(flat)) - np.repeat(start, n)
        out = np.zeros((len(n), width))
        out[row[place < width], place[place < width]] = flat[place < width]
    ok = np.isfinite(out).all(axis=1) if width else np.ones(len(n), bool)
    return at[ok], out[ok]


def scaled(m: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * m) as longs, held within -most and most."""
    return np.clip(np.floor(m * factor), -most, most).astype(np.int64)


def extent(df: DataFrame, vec_col: str, factor: int, most: int) -> tuple[int, int, int]:
    """(usable vectors, entries of the longest, greatest absolute scaled entry): one row a task."""
    def look(batches):
        rows = width = top = 0
        for b in batches:
            col = b.column(0)
            wide = pc.max(pc.list_value_length(col)).as_py() or 0
            at, m = matrix(col, wide)
            rows += len(at)
            if len(at):
                lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)[at]
                width = max(width, int(lengths.max()))
                top = max(top, int(np.abs(scaled(m, factor, most)).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64()), "w": pa.array([width], pa.int32()), "t": pa.array([top], pa.int64())})

    got = (df.select(vec_col).mapInArrow(look, "n long, w int, t long")
           .agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.max("t").alias("t")).first())
    return got["n"] or 0, got["w"] or 0, got["t"] or 0


def packed_type(top: int) -> str:
    """The narrowest integer type for entries up to ``top``."""
    return "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
