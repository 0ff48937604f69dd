"""Top-k search, spelling variants and whitening against brute force, on edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarifa.llm import covertree, spelling, vectors, whitening

VEC = "vec_id long, embedding array<float>, label int, id long, v string, ids string, block int, key string, score string, `a.b` int"


def embed(spark, rows, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "v", "i", 3, "k", "s", 4) for i, v in rows], VEC).repartition(parts)


def usable(rows, width):
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, np.array([*map(np.float32, v), *[0.0] * (width - len(v))], dtype=float)))
    return out


# --- op11 ------------------------------------------------------------------------------------------------------

def best_scores(rows, width, k=5, every=50):
    own = [(i, [int(x) for x in np.floor(256 * v)]) for i, v in usable(rows, width) if i is not None]
    out = Counter()
    for a, (i, q) in enumerate(own):
        if i % every == 0:
            got = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), j) for b, (j, r) in enumerate(own) if a != b)
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(got[:k]))
    return out


def cloud(n, d, seed, spots=8, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((spots, d))
    m = c[rng.integers(0, spots, n)] + spread * rng.standard_normal((n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_tree_covers_and_separates():
    for m in (cloud(700, 6, 1).astype(float) * 256, np.random.default_rng(2).standard_normal((500, 40)), np.zeros((300, 3)), np.zeros((0, 3)), np.ones((1, 2))):
        t = covertree.Tree(m)
        assert sorted(t.order) == list(range(len(m)))
        for i in range(len(t.lo)):
            own = m[t.order[t.lo[i]:t.hi[i]]]
            assert np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max() <= t.radius[i]
            kids = t.kids[t.first[i]:t.first[i] + t.count[i]]
            if kids:
                assert (t.lo[kids[0]], t.hi[kids[-1]]) == (t.lo[i], t.hi[i])
                assert all(t.hi[a] == t.lo[b] for a, b in zip(kids, kids[1:], strict=False))
        again = covertree.Tree.unpacked(t.packed())
        assert again.kids == t.kids and all((getattr(again, x) == getattr(t, x)).all() for x in ("lo", "hi", "radius", "first", "count"))


def test_search_prunes_and_is_exact():
    m = np.floor(cloud(3000, 8, 3) * 256).astype(float)
    t, q = covertree.Tree(m), covertree.Tree(m[:200])
    qm, rm = m[:200][q.order], m[t.order]
    ids = np.full((3000, 3), covertree.NO_ID)
    ids[:, 0] = t.order
    score, who, compared = covertree.search(qm, q, rm, t, ids, 3, np.full(200, -np.inf))
    assert compared < 200 * 3000 / 3
    for i in range(200):
        s = rm @ qm[i]
        at = np.lexsort((t.order, -s))[:3]
        assert (score[i] == s[at]).all() and (who[i] == t.order[at]).all()


@pytest.mark.parametrize("block,leaf_rows", [(4096, 900), (64, 900)])
def test_top_scores(spark, monkeypatch, block, leaf_rows):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 8)
    m = cloud(leaf_rows, 12, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(1000 + i, m[7].tolist()) for i in range(400)]                       # a vector of a third of the rows
    rows += [(1500, None), (1550, [float("nan")] * 12), (1600, [float("inf")] + [0.0] * 11), (1650, [None] * 12), (None, m[0].tolist())]
    rows += [(1700, [0.0] * 12), (1750, []), (1800, [1.0, 2.0]), (50, m[50].tolist()), (50, m[51].tolist()), (-100, (-m[3]).tolist())]
    got = found(covertree.top_scores(embed(spark, rows)))
    assert got == best_scores(rows, 12)


def test_top_scores_few_rows(spark):
    assert not found(covertree.top_scores(embed(spark, [])))
    assert not found(covertree.top_scores(embed(spark, [(1, [1.0]), (2, [2.0])])))
    assert not found(covertree.top_scores(embed(spark, [(50, [1.0, 0.5])])))
    rows = [(0, [1.0, 0.5]), (1, [-1.0, 2.0]), (2, [0.0, 0.0])]
    assert found(covertree.top_scores(embed(spark, rows))) == best_scores(rows, 2)
    with pytest.raises(ValueError):
        covertree.top_scores(embed(spark, [(0, [3e38]), (1, [1.0])]))


# --- op13 ------------------------------------------------------------------------------------------------------

def dense(rows, width):
    own = usable(rows, width)
    x = [[int(c) + 10 ** 6 for c in np.floor(64 * v)] for _, v in own]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in fit])
    cov = a.T @ a / n
    e, v = np.linalg.eigh(cov)
    return own, x, n, s, cov, e[::-1], v[:, ::-1]


def check_whitened(spark, rows, width, parts=4, tol=1e-9):
    got = whitening.whiten(embed(spark, rows, parts)).collect()
    own, x, n, s, cov, e, v = dense(rows, width)
    keep = [i for i in range(min(16, width)) if e[i] > 1e-12 * e[0]]
    by = defaultdict(list)
    for r in got:
        by[(r["vec_id"], r["component"])].append(r)
    assert len(got) == len(own) * len(keep)
    signs = np.zeros(len(keep))
    want = defaultdict(list)
    for (i, _), xi in zip(own, x, strict=True):
        centred = np.array([(n * c - t) / n for c, t in zip(xi, s, strict=True)])
        for k in keep:
            want[(i, k + 1)].append((sum((n * c - t) ** 2 for c, t in zip(xi, s, strict=True)), centred @ v[:, k] / np.sqrt(e[k])))
    for key, rs in by.items():
        k = key[1] - 1
        ws = want[key]
        assert sorted(r["deviation"] for r in rs) == sorted(w[0] for w in ws)
        assert np.allclose(sorted(abs(r["whitened"]) for r in rs), sorted(abs(w[1]) for w in ws), atol=tol * 100)
        for r in rs:
            assert r["n"] == n and abs(r["explained"] / (e[k] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9
        if len(rs) == 1 and abs(ws[0][1]) > 1e-3:
            sign = np.sign(rs[0]["whitened"] * ws[0][1])
            assert signs[k] in (0, sign)
            signs[k] = sign
    assert set(by) == set(want)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((500, 20)) * np.linspace(3, 0.5, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[4].tolist()) for i in range(250)]
    rows += [(2000, None), (2001, [float("nan")] * 20), (2002, [None] * 20), (2003, [0.5]), (2004, []), (None, m[9].tolist()), (3, m[3].tolist())]
    check_whitened(spark, rows, 20)


def test_whiten_without_variance_in_places(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 6))
    m[:, 2] = 5.0
    m[:, 4] = np.floor(64 * m[:, 1]) / 64
    m[:, 1] = m[:, 4]
    check_whitened(spark, [(i, v.tolist()) for i, v in enumerate(m)], 6, tol=1e-6)
    few = rng.standard_normal((4, 9)).tolist()                                   # fewer rows than entries
    assert {r["component"] for r in whitening.whiten(embed(spark, list(enumerate(few)))).collect()} == {1, 2, 3}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])]):
        assert whitening.whiten(embed(spark, rows)).collect() == []


def test_whiten_equal_deviations(spark):
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(np.vstack([np.eye(5), -np.eye(5)]))]
    got = whitening.whiten(embed(spark, rows)).collect()                         # five times the same eigenvalue
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5} and max(r["identity_error"] for r in got) < 1e-9
    assert all(abs(r["explained"] - 0.2) < 1e-9 for r in got)


def test_whiten_many_partial_sums_and_large_entries(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    check_whitened(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 5)))], 5, parts=8)
    got = whitening.whiten(embed(spark, [(i, [1e9 * i, 1.0 * (i % 3)]) for i in range(60)])).collect()
    assert {r["deviation"] for r in got} == {None} or all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def test_matrix_of_ragged_rows():
    import pyarrow as pa
    at, m = vectors.matrix(pa.array([[1.0], None, [1.0, 2.0, 3.0], [], [None, 1.0]], pa.list_(pa.float32())), 3)
    assert at.tolist() == [0, 2, 3] and m.tolist() == [[1, 0, 0], [1, 2, 3], [0, 0, 0]]


# --- op12 ------------------------------------------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in by.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows():
    rng = random.Random(6)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    pool = []
    for w in base:
        pool += [w] * rng.randint(3, 40)
        x = w
        for _ in range(3):                                                       # chains of edits
            at, how = rng.randrange(len(x)), rng.randrange(3)
            x = x[:at] + (rng.choice(letters) if how else "") + x[at + (how != 2):]
            pool += [x] * rng.randint(1, 12)
    pool += ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["aaaa"] * 30 + ["ababab"] * 5 + ["bababa"] * 5 + ["ÀÉabc"] * 4 + ["àéabc"] * 4 + ["x×y÷z"] * 3
    rng.shuffle(pool)
    texts = [" ".join(pool[i:i + 40]) for i in range(0, len(pool), 40)]
    texts += [None, "", "  ", "Abcde ABCDE abcde", texts[0].upper(), texts[1], texts[1], "x" * 5000 + " " + "hot word " * 20000, "日本語 " * 5, "one,two;three"]
    rows = list(enumerate(texts))
    return rows + [(None, texts[2]), (3, texts[3]), (3, texts[3]), (-7, texts[4])]


WORD = "doc_id long, text string, word string, n long, key string, id long, `a.b` int"


def test_spelling_variants(spark, monkeypatch):
    rows = variant_rows()
    monkeypatch.setattr(spelling, "_PORTION", 997)
    df = spark.createDataFrame([(i, t, "w", 1, "k", 2, 3) for i, t in rows], WORD).repartition(5)
    got = found(spelling.document_variants(df))
    assert got == brute_variants(rows)
    assert any(r[2] != (r[1] or r[0]) for r in got)                               # some chain has two steps
    assert not found(spelling.document_variants(df.where("false")))


def test_near_words_random(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(600)})
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b)}


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(9)
    for _ in range(300):
        places = sorted(rng.sample(range(10), rng.randint(3, 6)))
        prefix = [(p, rng.randint(1, 9), 0) for p in places]
        got = spelling.pivots(prefix)
        pairs = [(a, b) for a in prefix for b in prefix if b[0] - a[0] >= 2]
        if pairs:
            assert got[1][0] - got[0][0] >= 2 and sum(g[1] for g in got) == min(a[1] + b[1] for a, b in pairs)


def test_variants_need_a_ratio(spark):
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([("abcde", 3)], "word string, n long"), ratio=1)
