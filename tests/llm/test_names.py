"""Operators that keep all columns: names that the operators use themselves, names with dots, names of the results."""

import collections
import inspect
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from tarifa.llm import bpe, common, decontam, exact, quality, sharding, simhash
from test_llm import BPE, words

#: every name in quotes in the modules of the stages, so that a new internal name is tested too
INTERNAL = sorted({n for m in (bpe, common, decontam, exact, quality, sharding, simhash)
                   for n in re.findall(r'"(_*[a-z][a-z0-9_]*)"', inspect.getsource(m))} - {"doc_id", "text"})
NAMES = ["doc_id", "text", "a.b", "x y", "c0", "c1", *INTERNAL]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(30)]
    texts = [*base, base[0], base[1].upper(), base[2] + " tail", None, "", "x"]
    rows = [(i, t, *[f"{n}-{i}" for n in NAMES[2:]]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in NAMES)).repartition(3)


def by_id(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


def test_columns_come_through_unchanged(spark, docs):
    before, texts = by_id(docs), {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    items = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    runs = {"exact": exact.drop_exact_copies(docs), "near": simhash.keep_one(docs), "clean": decontam.drop_contaminated(docs, items),
            "good": quality.keep_good(docs, labels), "ids": bpe.encode_texts(docs, BPE, public_tokenizers.PATTERN),
            "shards": sharding.shard_rows(docs, "text", ["doc_id"], 3)}
    got = {}
    for name, df in runs.items():
        assert df.columns[:len(NAMES)] == NAMES, name
        got[name] = by_id(df)
        assert all(r[:len(NAMES)] == before[i] for i, r in got[name].items()), name
    assert set(before) - set(got["exact"]) == {0, 33}                     # of equal texts the largest id stays; null equals empty
    assert 30 not in got["near"] and set(got["near"]) <= set(before)
    assert set(before) - set(got["clean"]) == {5}
    assert len(got["ids"]) == len(got["shards"]) == len(before)
    assert runs["ids"].columns[len(NAMES):] == ["ids_"] and runs["shards"].columns[len(NAMES):] == ["shard_", "slot_"]
    assert sorted(collections.Counter(r[-2] for r in got["shards"].values()).values()) == [12, 12, 12]


def test_stages_keep_the_columns(spark, docs, tmp_path):
    for table, df in (("documents", docs), ("labels", spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")),
                      ("benchmark", spark.createDataFrame([(1, "no such passage in any of the documents here")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == NAMES, name
    before = by_id(docs)
    assert all(r == before[i] for i, r in by_id(d).items())
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
