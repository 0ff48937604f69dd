"""Token-id files coded by a static range asymmetric numeral system (rANS).

Container: Parquet, so that Spark's commit protocol covers lost tasks and any store Spark knows will do.
Below the output path lie ``model`` (symbol, freq: the shared table, frequencies summing to 2^BITS) and
``frames`` (part, block, n_tokens, frame). Frames in order of (part, block) hold the documents in ascending
doc_id order. A frame decodes by itself; all numbers are little-endian:

    4 s  magic "RNS1"
    6 u4 lanes, tokens, documents, words, checkpoint interval in steps, checkpoints
    i8   doc_id of each document;  u1 1 where it is null;  u4 its number of tokens
    u8   state of each lane
    per checkpoint: u4 words read before it, u8 state of each lane
    u4   words of the coded stream
    u4   CRC-32 of all the above

Token i is in lane i mod lanes, at step i div lanes. The lanes of a step are decoded together; those whose
state falls below 2^31 take one word each from the common stream, in lane order. A checkpoint holds the
states before its step, so parts of a frame can be decoded apart.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch_path

BITS = 20                # frequencies sum to 2^BITS
LANES = 2048
INTERVAL = 128           # steps between checkpoints
BLOCK = 1 << 20          # a frame is closed once it holds this many tokens
LOW = np.uint64(1 << 31)
CACHE = 1_000_000        # words a worker remembers; past that it starts afresh
PORTION = 8 << 20        # bytes of text encoded together
MARK = "\x01"            # set between matches that are encoded in one call
# the characters that stand for the bytes without a visible Latin-1 character of their own
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
BEYOND = re.compile("[^\x00-\u017f]").search


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and encodes each match of its pattern by
    itself, remembering the words already encoded.

    White space always ends a match and is not encoded, so the ids of a text are those of its words, one after the other,
    and the ids of a word those of its matches. Texts of plain letters (up to U+017F, where normalisation is lower-casing)
    are cut into words here, and each distinct word of many texts is looked up once; a text with any other character, or with the
    string of a special token in any case, is given to the tokenizer whole, which reads such a string as its one id.

    ``words[i]`` has the ids ``ids[at[i]:at[i + 1]]``: arrays, not a dict of strings and bytes, for memory's sake."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.t.get_added_tokens_decoder().values()]
        self.lead = os.path.commonprefix(self.special)
        steps = json.loads(self.t.to_str())["pre_tokenizer"]["pretokenizers"]
        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.mark = self._ids(MARK)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.model = self.t.model if len(steps) == 2 and byte_level.items() <= steps[1].items() else None
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.at = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of matches: by the tokenizer's model alone, in its byte alphabet, where that is the only step after the
        pattern; else many in one call, set apart by a mark of a single id."""
        parts = {}
        if self.model is not None:
            tokenize = self.model.tokenize
            for w in new:
                ids = [t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTES))]
                parts[w] = struct.pack(f"<{len(ids)}I", *ids)
            return parts
        for i in range(0, len(new), 5000):
            plain = [w for w in new[i:i + 5000] if MARK not in w]
            ids = np.array(self._ids(f" {MARK} ".join(plain)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if plain and len(cuts) == len(plain) - 1:
                raw, at = ids.tobytes(), 0
                for w, e in zip(plain, [*cuts.tolist(), len(ids)], strict=True):
                    parts[w] = raw[4 * at:4 * e]
                    at = e + 1
        for w in new:
            if w not in parts:
                parts[w] = np.array(self._ids(w), "<u4").tobytes()
        return parts

    def _cut(self, text: str) -> str | None:
        """The lower-case text, its words set apart by spaces, of a text that need not be given to the tokenizer whole."""
        if not text.isascii() and BEYOND(text):
            return None
        text = text.lower()
        if self.lead in text and any(s in text for s in self.special):
            return None
        return text.replace("\n", " ")

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where the ids of each start and how many there are, and the ids. New words are learnt."""
        number = pc.index_in(words, value_set=self.words)
        new = words.filter(number.is_null())
        cut = list(map(self.find, new.to_pylist()))
        parts = self._learn(list(dict.fromkeys(itertools.chain.from_iterable(cut))))
        made = [parts[ps[0]] if len(ps) == 1 else b"".join(map(parts.__getitem__, ps)) for ps in cut]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        fresh = np.frombuffer(b"".join(made), "<u4")
        ids = np.concatenate([self.ids, fresh])
        at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        place = number.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = np.arange(len(self.words), len(self.words) + len(new))
        start, count = at[place], at[place + 1] - at[place]
        short = pc.less_equal(pc.binary_length(new), 64)
        keep = short.to_numpy(zero_copy_only=False)
        self.words = pa.concat_arrays([self.words, new.filter(short)])              # very long words are not remembered
        self.ids = np.concatenate([self.ids, fresh[np.repeat(keep, sizes)]])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes[keep])])
        return start, count, ids

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = words.flatten().dictionary_encode()
        start, count, ids = self._places(flat.dictionary)
        index = flat.indices.to_numpy()
        n = count[index]
        ends = np.cumsum(n)
        at = np.repeat(start[index] - (ends - n), n)
        at += np.arange(len(at))
        raw = ids[at].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[words.offsets.to_numpy()]).tolist()
        return [raw[a:e] for a, e in itertools.pairwise(bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > CACHE:
            self._forget()
        plain = list(map(self._cut, texts))
        got = iter(self._by_words([t for t in plain if t is not None]))
        return [np.array(self._ids(t), "<u4").tobytes() if p is None else next(got) for t, p in zip(texts, plain, strict=True)]


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenize(df: DataFrame, path: str, end_id: int | None = 1) -> DataFrame:
    """doc_id, crc (of the ids), ids (zstd of unsigned 32-bit ids) of each document; null texts are empty."""
    def run(batches):
        enc, z = word_encoder(path), zstandard.ZstdCompressor(level=1)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // PORTION)) + 1).tolist(), b.num_rows]
            for at, e in itertools.pairwise(cuts):
                part = b.slice(at, e - at)
                ids = [x + end for x in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                     pa.array([z.compress(np.frombuffer(x, "<u4").view("<u2").reshape(-1, 2).T.tobytes()) for x in ids], pa.binary())],
                    names=["doc_id", "crc", "ids"])

    return (df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, crc long, ids binary"))


def _unpack(z: zstandard.ZstdDecompressor, blob: bytes) -> np.ndarray:
    return np.frombuffer(z.decompress(blob), "<u2").reshape(2, -1).T.copy().view("<u4").reshape(-1)


def count_symbols(tokens: DataFrame) -> DataFrame:
    """symbol, n over all documents."""
    def run(batches):
        z, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                n = np.bincount(_unpack(z, blob))
                if len(n) > len(total):
                    n[:len(total)] += total
                    total = n
                else:
                    total[:len(n)] += n
        s = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(total[s], pa.int64())], names=["symbol", "n"])

    return tokens.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def quantise(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and their frequencies: at least 1 each, 2^BITS in all."""
    sym = np.array(sorted(counts), np.int64)
    if not len(sym):
        return sym, np.zeros(0, np.int64)
    n = np.array([counts[s] for s in sym.tolist()], np.float64)
    freq = 1 + np.floor(n * ((1 << BITS) - len(sym)) / n.sum()).astype(np.int64)
    freq[np.argmax(freq)] += (1 << BITS) - freq.sum()
    return sym, freq


class Model:
    def __init__(self, sym: np.ndarray, freq: np.ndarray):
        self.sym, self.freq = sym, freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.index = np.zeros(int(sym.max(initial=-1)) + 1, np.int64)
        self.index[sym] = np.arange(len(sym))

    @functools.cached_property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sym)), self.freq.astype(np.int64))


def encode_frame(ids: np.ndarray, docs: list, lengths: list[int], m: Model) -> bytes:
    s = m.index[ids]
    f, c = m.freq[s], m.cum[s]
    limit = f << np.uint64(63 - BITS)
    x = np.full(LANES, LOW)
    chunks, words, marks = [], 0, []
    for t in range(-(-len(s) // LANES) - 1, -1, -1):
        a, e = t * LANES, min((t + 1) * LANES, len(s))
        y = x[:e - a]
        out = y >= limit[a:e]
        if out.any():
            chunk = y[out].astype("<u4")
            chunks.append(chunk)
            words += len(chunk)
            y[out] >>= np.uint64(32)
        q = y // f[a:e]
        y += q * ((np.uint64(1 << BITS)) - f[a:e]) + c[a:e]      # (q << BITS) + (y - q * f) + c
        if t and t % INTERVAL == 0:
            marks.append((words, x.copy()))
    head = struct.pack("<4s6I", b"RNS1", LANES, len(s), len(docs), words, INTERVAL, len(marks))
    body = [head, np.array([0 if d is None else d for d in docs], "<i8").tobytes(), bytes(d is None for d in docs),
            np.array(lengths, "<u4").tobytes(), x.astype("<u8").tobytes()]
    for done, state in reversed(marks):
        body += [struct.pack("<I", words - done), state.astype("<u8").tobytes()]
    body += [chunk.tobytes() for chunk in reversed(chunks)]
    raw = b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


def _decode_steps(x: np.ndarray, words: np.ndarray, at: int, first: int, last: int, n: int, lanes: int, m: Model,
                  out: np.ndarray) -> None:
    low = np.uint64((1 << BITS) - 1)
    for t in range(first, last):
        a, e = t * lanes, min((t + 1) * lanes, n)
        y = x[:e - a]
        slot = y & low
        s = m.slots[slot.astype(np.int64)]
        out[a:e] = m.sym[s]
        y = m.freq[s] * (y >> np.uint64(BITS)) + slot - m.cum[s]
        need = np.flatnonzero(y < LOW)
        y[need] = (y[need] << np.uint64(32)) | words[at:at + len(need)]
        at += len(need)
        x[:e - a] = y


def decode_frame(frame: bytes, m: Model) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids. Raises ValueError when the checksum or the magic does not agree."""
    if frame[:4] != b"RNS1" or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("damaged frame")
    lanes, n, docs, n_words, interval, marks = struct.unpack("<6I", frame[4:28])
    at = 28

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(frame, kind, k, at)
        at += got.nbytes
        return got

    ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    starts = [(0, 0, take("<u8", lanes).copy())]
    for i in range(marks):
        pos = int(take("<u4", 1)[0])
        starts.append(((i + 1) * interval, pos, take("<u8", lanes).copy()))
    words, out = take("<u4", n_words).astype(np.uint64), np.zeros(n, "<u4")
    steps = -(-n // lanes)
    for i, (first, pos, state) in enumerate(starts):              # each part stands alone
        _decode_steps(state, words, pos, first, starts[i + 1][0] if i + 1 < len(starts) else steps, n, lanes, m, out)
    return [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)], lengths, out


def write_tokens(docs: DataFrame, vocab: str, path: str, end_id: int | None = 1) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the coded ids below ``path``.

    Ascending doc_id, nulls first; rows of equal doc_id by the checksum of their ids. A null text is empty and
    gets the end id alone. Rows are dealt by range of (doc_id, checksum), so a doc_id held by many rows is
    split. An empty table gives an empty model and no frames."""
    spark = docs.sparkSession
    tokens = checkpoint(tokenize(docs, vocab, end_id))
    counts = {r["symbol"]: r["n"] for r in count_symbols(tokens).collect()}       # at most one row an id of the vocabulary
    sym, freq = quantise(counts)
    spark.createDataFrame(list(zip(sym.tolist(), freq.tolist(), strict=True)), "symbol long, freq long").coalesce(1).write.parquet(f"{path}/model")

    def run(batches):
        from pyspark import TaskContext

        part, block, z, m = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor(), Model(sym, freq)
        ids, doc, size = [], [], 0

        def frame():
            nonlocal ids, doc, size, block
            raw = encode_frame(np.concatenate(ids) if ids else np.zeros(0, "<u4"), doc, [len(x) for x in ids], m)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()),
                                              pa.array([raw], pa.binary())], names=["part", "block", "n_tokens", "frame"])
            ids, doc, size, block = [], [], 0, block + 1
            return row

        for b in batches:
            for d, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(_unpack(z, blob))
                doc.append(d)
                size += len(ids[-1])
                if size >= BLOCK:
                    yield frame()
        if doc:
            yield frame()

    (tokens.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
     .mapInArrow(run, "part int, block int, n_tokens long, frame binary")
     .write.option("compression", "none").parquet(f"{path}/frames"))


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """What ``write_tokens`` wrote: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit,
    little-endian) or, with ``digest``, ids_crc32 in their place."""
    model = spark.read.parquet(f"{path}/model").orderBy("symbol").collect()
    sym, freq = np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model], np.int64)
    frames = spark.read.parquet(f"{path}/frames")
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")

    def run(batches):
        m = Model(sym, freq)
        for b in batches:
            for part, block, frame in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                doc, lengths, ids = decode_frame(frame, m)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.tobytes())
                each = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc), pa.int32()), pa.array([block] * len(doc), pa.int32()), pa.array(doc, pa.int64()),
                     pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([zlib.crc32(x) if digest else bytes(x) for x in each], last[1])],
                    names=["part", "block", "doc_id", "own", "n_tokens", last[0]])

    docs = frames.select("part", "block", "frame").mapInArrow(
        run, f"part int, block int, doc_id long, own long, n_tokens long, {last[0]} {last[2]}")
    sizes = frames.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select(
        "part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("a"))        # one row a partition
    within = sizes.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block"))
                                            - F.col("n_tokens")).alias("b"))
    offsets = within.join(parts, "part").select("part", "block", (F.col("a") + F.col("b")).alias("base"))
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", last[0])


def file_digests(docs: DataFrame, vocab: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from files written for this call."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocab, path, end_id)
    return read_tokens(docs.sparkSession, path, digest=True)
