"""Exact dedup with a two-pass Bloom filter: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from .common import by_place, checkpoint

SEGMENT = 1 << 16        # filter slots that are merged together
SLOTS_PER_ROW = 16       # with 4 hash positions about 0.3 % of the unrepeated rows are shuffled needlessly
MAX_SLOTS = 1 << 26      # proven bound of what is broadcast: 2^26 bits = 8 MB
HASHES = 4


def _digest(text) -> bytes:
    return hashlib.sha256((text or b"").lower()).digest()   # bytes.lower() changes A-Z only


def _slots(digests, slots: int) -> np.ndarray:
    """HASHES filter slots of each 32-byte digest, one row per digest."""
    a = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    i = np.arange(HASHES, dtype=np.uint64)
    return ((a[:, :1] + i * (a[:, 1:2] | np.uint64(1))) & np.uint64(slots - 1)).astype(np.int64)


def _repeat_filter(digests: DataFrame, slots: int) -> np.ndarray:
    """First pass: bits of the slots that two or more rows set. Each task counts 0, 1, 2+ per slot over
    its own rows and hands on one compressed piece per segment; a merging task streams the pieces and
    keeps one segment state each, so memory depends on ``slots`` only."""
    segments = max(1, slots // SEGMENT)
    width = slots // segments

    def count(batches):
        state = np.zeros(slots, np.uint8)
        for b in batches:
            if b.num_rows:
                u, c = np.unique(_slots(b.column(0).to_pylist(), slots), return_counts=True)
                state[u] = np.minimum(2, state[u] + np.minimum(2, c)).astype(np.uint8)
        for s in range(segments):
            part = state[s * width:(s + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()),
                                                  "piece": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches):
        states: dict[int, np.ndarray] = {}
        for b in batches:
            for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(z), np.uint8)
                states[s] = np.minimum(2, states[s] + part) if s in states else part
        for s, state in states.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()),
                                              "piece": pa.array([np.packbits(state > 1).tobytes()], pa.binary())})

    schema = "segment int, piece binary"
    merged = digests.select("sha").mapInArrow(count, schema).repartition("segment").mapInArrow(merge, schema)
    bits = np.zeros(slots // 8, np.uint8)
    for r in merged.collect():   # at most MAX_SLOTS bits
        bits[r["segment"] * width // 8:(r["segment"] + 1) * width // 8] = np.frombuffer(r["piece"], np.uint8)
    return bits


def _slot_count(rows: int, max_slots: int) -> int:
    return int(min(max_slots, max(SEGMENT, 1 << (SLOTS_PER_ROW * max(rows, 1) - 1).bit_length())))


def with_digest(df: DataFrame, text_col: str, shared=None, slots: int = 0) -> DataFrame:
    """``df`` with ``sha`` (SHA-256 of the text, A-Z lower-cased) and, given the broadcast filter,
    ``maybe``: whether its slots are all set, i.e. its text may occur again."""
    def run(batches):
        for b in batches:
            sha = [_digest(t) for t in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            cols = [*b.columns, pa.array(sha, pa.binary())]
            names = [*b.schema.names, "__sha"]
            if shared is not None:
                p = _slots(sha, slots) if sha else np.zeros((0, HASHES), np.int64)
                hit = (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
                cols.append(pa.array(hit.all(axis=1)))
                names.append("__maybe")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = [StructField("__sha", BinaryType())] + [StructField("__maybe", BooleanType())] * (shared is not None)
    return df.mapInArrow(run, StructType(df.schema.fields + more))


def _candidates(df: DataFrame, id_col: str, text_col: str, max_slots: int):
    """Digest table (id, sha, maybe) and the broadcast filter."""
    sc = df.sparkSession.sparkContext
    digests = checkpoint(with_digest(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text")
                         .select("id", F.col("__sha").alias("sha")))
    slots = _slot_count(digests.count(), max_slots)
    shared = sc.broadcast(_repeat_filter(digests, slots))

    def test(batches):
        for b in batches:
            p = _slots(b.column(1).to_pylist(), slots) if b.num_rows else np.zeros((0, HASHES), np.int64)
            hit = (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit.all(axis=1))], names=["id", "sha", "maybe"])

    return digests.mapInArrow(test, StructType([*digests.schema.fields, StructField("maybe", BooleanType())])), shared, slots


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id
    of a group stays; null ids come below all others. Rows that repeat id and text count separately in
    ``group_size`` and just one of them is kept. An empty table gives an empty result. Extra columns,
    whatever their names, are ignored.

    The filter has no false negatives, so a row it clears is unique and passes straight through; the rest
    are grouped by their whole digest. The filter is bounded by ``max_slots`` bits: beyond
    ``max_slots / 16`` rows it clears fewer rows, and the result stays exact."""
    flagged, _, _ = _candidates(df, id_col, text_col, max_slots)
    alone = flagged.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = flagged.where("maybe").groupBy("sha", "id").agg(F.count("*").alias("copies"))
    # written out, so that the join has plain exchanges on both sides and a hot group's rows can be split
    groups = checkpoint(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    found = (maybe.join(groups, "sha")
             .select("id", "keep_id", "group_size", "sha", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
             .select("id", "keep_id", "group_size",
                     (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("pos") == 0)).alias("kept"), "sha"))
    return (alone.unionByName(found)
            .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows of ``df``, all columns, with one row per group of equal texts: that of the largest id; of
    rows with the same id and text the largest in all columns. Rows cleared by the filter do not shuffle. Columns may
    have any names."""
    return by_place(df, [id_col, text_col], lambda d, i, t: _drop_exact_copies(d, i, t, max_slots))


def _drop_exact_copies(df: DataFrame, id_col: str, text_col: str, max_slots: int) -> DataFrame:
    flagged, shared, slots = _candidates(df, id_col, text_col, max_slots)
    keep = (flagged.where("maybe").groupBy(F.col("sha").alias("__k")).agg(F.max("id").alias("__keep")))
    rows = with_digest(df, text_col, shared, slots)
    alone = rows.where(~F.col("__maybe")).select(*df.columns)
    chosen = (rows.where("__maybe").join(keep, (F.col("__sha") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__keep")))
              .groupBy("__k").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
              .select("__row.*"))
    return alone.unionByName(chosen)
