"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of BLOCK bytes (all of it, so length does not wash the dictionaries out) and each block
is compressed with either dictionary. The normalised difference of the two sizes is the main evidence; the
compressed size per byte tells repetitive text. A logistic fit on labelled rows turns both into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_place, checkpoint, smallest

BLOCK = 2048             # bytes compressed at a time
FRAME = 8                # bytes of a frame that hold no text
LEVEL = 3
DICT_BYTES = 64 * 1024
SAMPLE = 6000            # bound of the labelled rows used, of each class; half build the dictionaries, half calibrate
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool                          # the dictionaries are plain text, too few rows to train on
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=kind) if content else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            yield zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False)


def sizes(text: bytes, good, bad) -> tuple[int, int]:
    g = b = 0
    for i in range(0, len(text), BLOCK):
        block = text[i:i + BLOCK]
        g += max(1, len(good.compress(block)) - FRAME)
        b += max(1, len(bad.compress(block)) - FRAME)
    return g, b


def design(n: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inputs of the fit from text bytes and the compressed sizes."""
    n = np.maximum(n, 1)
    d = (b - g) / np.maximum(np.maximum(g, b), 1)
    m = np.minimum(g, b) / n
    return np.c_[np.ones(len(n)), d, d * np.abs(d), d * m, d / (1 + np.exp(5 - np.log(n + 1.0))),
                 m, m * m, 0.1 / np.maximum(m, 0.02), 5 / np.sqrt(n + 1.0)]


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1):
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale == 0] = 0, 1
    a, beta = (x - mean) / scale, np.zeros(x.shape[1])
    w = w * len(w) / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), False
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-DICT_BYTES:], True


def _sizes_of(df: DataFrame, m: Model) -> DataFrame:
    """``df`` (.., text last) with nbytes, g, b."""
    def run(batches):
        good, bad = m.compressors()
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            got = [sizes(t, good, bad) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array([s[0] for s in got], pa.int64()),
                 pa.array([s[1] for s in got], pa.int64())], names=[*batch.schema.names[:-1], "nbytes", "g", "b"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{head}, nbytes long, g long, b long")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled rows that are not held out; None when a class has no row.

    At most ``sample`` rows of each class are used, those with the smallest hashes of doc_id; rows labelled both
    ways are left out. The ids are a bounded broadcast, so no text is shuffled."""
    ids = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__q")).where("quality = __q"))
    ids = checkpoint(ids.select("doc_id", "quality", F.xxhash64("doc_id").alias("rank")))
    total = {r["quality"]: r["n"] for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    bad_ids, good_ids = (smallest(ids.where(F.col("quality") == q), "rank", sample) for q in (0, 1))
    pick = bad_ids.unionByName(good_ids)
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
            .join(F.broadcast(pick), "doc_id").select("quality", "rank", "text"))
    first = F.pmod("rank", F.lit(2)) == 0
    blocks = F.greatest(F.lit(1), F.ceil(F.length("text") / BLOCK))
    sample_texts = (rows.where(first).withColumn("at", F.pmod(F.xxhash64("rank"), blocks) * BLOCK + 1)
                    .select("quality", "rank", F.expr(f"substring(text, cast(at as int), {BLOCK})").alias("text"))
                    .orderBy("quality", "rank", "text").collect())                        # <= sample blocks
    parts = {q: [r["text"].encode() for r in sample_texts if r["quality"] == q] for q in (0, 1)}
    if not parts[0] or not parts[1]:
        return None
    (bad, raw_bad), (good, raw_good) = _dictionary(parts[0]), _dictionary(parts[1])
    if raw_bad != raw_good:
        bad, good = (b"\n".join(parts[q])[-DICT_BYTES:] for q in (0, 1))
    m = Model(good, bad, raw_bad or raw_good, np.zeros(0), np.zeros(0), np.zeros(0))
    seen = _sizes_of(rows.where(~first).select("quality", "rank", "text"), m).orderBy("rank", "nbytes", "g", "b").collect()  # <= sample rows
    y = np.array([r["quality"] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return None
    w = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    x = design(*(np.array([r[c] for r in seen], float) for c in ("nbytes", "g", "b")))
    m.mean, m.scale, m.weights = _fit(x, y, w)
    return m


def score(df: DataFrame, m: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out`` (0 to 1, higher: better) from the whole text. Empty and null texts score 0; without a model
    every other text scores 0.5. All rows and columns stay."""
    def run(batches):
        pair = tuple(m.compressors()) if m is not None else None
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).cast(pa.binary()).to_pylist()]
            n = np.array([len(t) for t in texts], float)
            if pair is None or not texts:
                p = np.full(len(texts), 0.5)
            else:
                s = np.array([sizes(t, *pair) for t in texts], float)
                z = (design(n, s[:, 0], s[:, 1]) - m.mean) / m.scale @ m.weights
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(n > 0, p, 0.0), pa.float64())],
                                             names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType(df.schema.fields + [StructField(out, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score THRESHOLD or more. Columns may have any names."""
    model = fit(docs.select("doc_id", "text"), labels, sample)
    return by_place(docs, ["text"], lambda d, t: score(d, model, t, "__score").where(F.col("__score") >= THRESHOLD).drop("__score"))
