"""Decontamination seeds against every (document, item) pair; special strings of the token files."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarifa.llm import decontam, rans
from tarifa.llm.common import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, item):
    """A copy with substituted, inserted and deleted words, from none to beyond the threshold."""
    rate, out = rng.choice([0, 0.1, 0.2, 0.3, 0.4]), []
    for w in item:
        r = rng.random()
        if r < rate:
            out += rng.choice([["sub"], [w, "ins"], ["ins", w], []])
        else:
            out.append(w)
    return out


def found(spark, docs, items, **kw):
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                spark.createDataFrame(items, "item_id long, text string"), **kw).collect()
    return {(r["id"], r["item"]): r["score"] for r in got}


def test_all_pairs(spark):
    rng = random.Random(1)
    items = [words(rng, n) for n in (7, 9, 12, 13, 15, 20, 26, 40, 59) for _ in range(3)]
    stock = words(rng, 5)
    items += [words(rng, 10) + stock + words(rng, 10) for _ in range(6)]
    docs = [words(rng, rng.randrange(60)) + edited(rng, rng.choice(items)) + words(rng, rng.randrange(60)) for _ in range(300)]
    docs += [words(rng, 30) + stock + words(rng, 30) for _ in range(60)] + [[], words(rng, 400)]
    got = found(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, " ".join(t)) for i, t in enumerate(items)])
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            score = decontam.align(t, d)[0] / (2 * len(t))
            if score >= 0.5:
                want[i, j] = score
    assert got == want and 100 < len(want) < 360
    assert any(s < 0.6 for s in want.values())


@pytest.mark.parametrize("length", [15, 20, 40])
def test_regular_edits(spark, length):
    """Every third to sixth word replaced, or a word put between any two."""
    item = [f"w{i}" for i in range(length)]
    docs = [["x"] * 30 + ["changed" if i % step == step - 1 else w for i, w in enumerate(item)] + ["y"] * 30 for step in (3, 4, 5, 6)]
    docs += [[x for w in item for x in (w, "ins")][:-1], [w for i, w in enumerate(item) if i % 4], [w for i, w in enumerate(item) if i % 2]]
    got = found(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], [(0, " ".join(item))])
    want = {(i, 0): decontam.align(item, d)[0] / (2 * length) for i, d in enumerate(docs)}
    assert got == {k: s for k, s in want.items() if s >= 0.5} and {i for i, _ in got} >= {0, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.7])
def test_shared_seeds(threshold):
    """A passage that reaches the threshold shares at least ``least`` places of the item's seeds."""
    rng = random.Random(int(threshold * 10))
    tried = 0
    for _ in range(3000):
        item = words(rng, rng.randint(7, 45), 30)
        copy = edited(rng, item)
        if decontam.align(item, copy)[0] < threshold * 2 * len(item):
            continue
        tried += 1
        q, gap, least = decontam.seed_shape(len(item), threshold=threshold)
        a, b = (np.concatenate([h for _, h in decontam.gapped(decontam._hashes([w.encode() for w in t]), q, gap)]) for t in (item, copy))
        assert gap == 0 or np.isin(a, b).sum() >= least
    assert tried > 500


def test_frequent_seeds_start_nothing(spark):
    """A phrase in many passages and items gives no (passage, item) pair where more than it must be shared."""
    rng = random.Random(2)
    stock = words(rng, 4, 10 ** 6)
    items = [words(rng, 20, 10 ** 6) + stock + words(rng, 20, 10 ** 6) for _ in range(20)]
    table = decontam.item_seeds(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    table = table.withColumnRenamed("item", "ref")
    hits = []
    for i in range(50):
        text = (items[i] if i < 5 else words(rng, 20, 10 ** 6) + stock + words(rng, 20, 10 ** 6))
        each = decontam._hashes([w.encode() for w in text])
        hits += [(i, h) for h in {int(x) for _, g in decontam.gapped(each, 4, 3) for x in g.view(np.int64)}]
    got = decontam.seed_pairs(spark.createDataFrame(hits, "passage long, hash long"), table).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(5)]


def test_special_strings(spark):
    t = Tokenizer.from_file(WORDS)
    texts = ["a <|endoftext|> b", "<|startoftext|>word<|endoftext|>", "<|ENDOFTEXT|> is text", "plain words", "<|endoftext|", "x<|endoftext|>\n<|endoftext|>", "",
             "<|EndOfText|><|endoftext|>", "é <|endoftext|> 日本"]
    path = scratch_path(spark, "special")
    rans.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), WORDS, path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rans.read_tokens(spark, path).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
