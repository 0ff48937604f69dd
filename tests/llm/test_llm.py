"""The training-data operators against brute force, on edge rows: nulls, empty and long texts, ties, repeats, odd columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tarifa.llm import bpe, chat, decontam, exact, pagetext, quality, rans, sharding, simhash, substring
from tarifa.llm.common import scratch_path

BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score string, sha string, row int, fp string, ids string, grp string"


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdluéü") for _ in range(rng.randint(1, 8))) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    base, passage = [words(rng, rng.randint(20, 120)) for _ in range(12)], words(rng, 60)
    texts = [*base, None, "", " \t\n", "one", "two words", "three word text", base[0], base[0].upper(), base[0] + "\n", "  " + base[1],
             base[2] + " end", *[base[3]] * 5, words(rng, 30) + " " + passage, passage + "\x0b" + words(rng, 10), passage.replace(" ", "\n"),
             words(rng, 9000), "a\xa0b\x1cc \x85 d", "x" * 30000, "日本語 テキスト 😀", "MIXED Case É é", "mixed case É é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (3, base[3]), (4, "another text of the same id"), (None, base[5]), (None, None), (10**12, base[6])]
    return [(i, t, "en" if k % 3 else None, None, None if t is None else len(t), 7, "k", "s", None, k, "f", "i", "g") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return edge_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def many(df):
    return collections.Counter(tuple(r) for r in df.collect())


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


# --- exact dedup ------------------------------------------------------------------------------------------------

def test_exact_groups(docs, rows):
    got = many(exact.exact_groups(docs))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda x: x is None):
            kept = left and i == keep
            left = left and not kept
            want[(i, keep, len(ids), kept, hashlib.sha256(t).hexdigest())] += 1
    assert got == want


def test_exact_small_filter_is_exact(docs):
    assert many(exact.exact_groups(docs, max_slots=64)) == many(exact.exact_groups(docs))


def test_drop_exact_copies(docs, rows):
    got = exact.drop_exact_copies(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len({lower(r[1]) for r in rows}) and set(kept) <= set(rows)
    assert {(lower(r[1]), r[0]) for r in kept} == {
        (t, max((r[0] for r in rows if lower(r[1]) == t and r[0] is not None), default=None)) for t in {lower(r[1]) for r in rows}}


# --- SimHash ----------------------------------------------------------------------------------------------------

def brute_print(t, shingle=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash(docs, rows):
    got = many(simhash.fingerprint_groups(docs))
    prints = [brute_print(r[1]) for r in rows]
    label = brute_components(prints, 4)
    least = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    assert got == collections.Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label))


@pytest.mark.parametrize("radius", [0, 3, 4, 5])
def test_links_and_chunks(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(6):                                    # chains of near prints
            prints.add(s)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                s ^= 1 << b
    prints = sorted(prints)
    d = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    label = brute_components(prints, radius)
    for chunk in (4096, 5):                                   # 5: every larger bucket is cut up
        root = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(d, radius, chunk)).collect()}
        mine = [root.get(p, p - (1 << 64) if p >> 63 else p) for p in prints]
        assert len(set(zip(mine, label))) == len(set(label)) == len(set(mine))


def test_components_until_stable(spark):
    order = random.Random(2).sample(range(-1000, 1000), 600)
    chains = [order[:400], order[400:]]
    edges = spark.createDataFrame([e for c in chains for e in zip(c, c[1:])], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {n: min(c) for c in chains for n in c if n != min(c)}
    with pytest.raises(RuntimeError):
        simhash.components(edges, limit=1)


def test_keep_one(docs, rows):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    prints = [brute_print(r[1]) for r in rows]
    label = brute_components(prints, 4)
    assert len(kept) == len(set(label)) and set(kept) <= set(rows)
    of = {tuple(r): c for r, c in zip(rows, label)}
    for r in kept:
        ids = [x[0] for x, c in zip(rows, label) if c == of[r] and x[0] is not None]
        assert r[0] == min(ids, default=None)


# --- quality ----------------------------------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        t = words(rng, rng.randint(20, 200))
        rows.append((i, t if good else " ".join(w + rng.choice(["***", "###"]) for w in t.split()), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, words(rng, 50))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (12345, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == 403 and got[900]["score"] == got[901]["score"] == 0.0 and got[900]["predicted"] == 0
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    held = [(got[i]["predicted"], q) for i, _, q in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert quality.keep_good(docs, labels).columns == docs.columns
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end quality")
    assert {r["doc_id"]: r["score"] for r in quality.score_documents(docs, flipped).collect()} == {k: r["score"] for k, r in got.items()}


def test_quality_edges(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.0, 0.5}
    assert quality.score_documents(nothing, none).count() == 0
    few = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, 0)], "doc_id long, quality int")
    assert quality.score_documents(docs, few).count() == docs.count()


# --- tokens -----------------------------------------------------------------------------------------------------

def test_token_files(spark, docs, rows):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    path = scratch_path(spark, "test")
    rans.write_tokens(docs, WORDS, path)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist())
                  for r in rans.read_tokens(spark, path).collect()), key=lambda r: r[2])
    want = collections.Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    assert collections.Counter((r[1], tuple(r[4])) for r in got) == want
    assert [r[:2] for r in got] == sorted([r[:2] for r in got], key=lambda x: (x[0], x[1] or 0))
    at = 0
    for _, _, start, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rans.read_tokens(spark, path, digest=True).collect()}
    assert all(crc[r[1], r[2]] == zlib.crc32(np.array(r[4], "<u4").tobytes()) for r in got)


def test_frames():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2047, 2048, 2049, 2048 * 300 + 5):
        ids = rng.zipf(1.3, n).clip(1, 40000).astype("<u4")
        sym, freq = rans.quantise(dict(collections.Counter(ids.tolist())) or {1: 1})
        assert freq.sum() == 1 << rans.BITS and freq.min() > 0
        m = rans.Model(sym, freq)
        raw = rans.encode_frame(ids, [4, None], [n, 0], m)
        doc, lengths, back = rans.decode_frame(raw, m)
        assert doc == [4, None] and lengths.tolist() == [n, 0] and (back == ids).all()
        with pytest.raises(ValueError):
            rans.decode_frame(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], m)


def test_byte_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in rows:
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4")
        want[(r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert many(bpe.digests(docs, BPE, public_tokenizers.PATTERN)) == want
    both = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text"), BPE, public_tokenizers.PATTERN), BPE)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())


def test_merge_long_and_lower_ranks():
    # "bc" (rank 259) makes "abc" (rank 256) possible, which then comes before the pairs of rank 259 that are left
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"dd": 257, b"bc": 259}
    rng = random.Random(2)
    enc = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks | {b"zzzz": 258}, special_tokens={})
    for n in (1, 2, 7, 300):
        for _ in range(60):
            t = "".join(rng.choice("abcdz") for _ in range(n))
            assert bpe.merge(t.encode(), ranks | {b"zzzz": 258}) == enc.encode_ordinary(t)
    many = ["".join(rng.choice("abcdz") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    got = bpe.merge_many([t.encode() for t in many], ranks, bpe.Table(ranks))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [bpe.merge(t.encode(), ranks) for t in many]


# --- chat -------------------------------------------------------------------------------------------------------

def test_chat(spark):
    a, b, c = [("user", "hi"), ("assistant", "hello"), ("user", "more")], [("user", "hi"), ("assistant", "other")], [(None, None)]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: b, 6: c, 7: [("user", "")], 8: [("user", "hi\nassistant")]}
    turns = [(i, k, role, text, 1, "x") for i, log in logs.items() for k, (role, text) in enumerate(log)]
    turns += [(3, 0, "user", "hi", 1, "x"), (None, 0, "user", "hi", 1, "x"), (9, None, "user", "hi", 1, "x"), (9, 1, "assistant", "hello", 1, "x")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, k int, n string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.collapse_and_render(d).collect()}
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3] == (3, 2, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a))
    assert got[6] == (1, 1, "<|im_start|>\n<|im_end|>\n")
    assert chat.collapse_and_render(d.limit(0)).count() == 0


# --- pages ------------------------------------------------------------------------------------------------------

PAGES = {
    "plain": ("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A  title &amp; more</h1>"
              "<p>First paragraph of the\n text, long enough.</p><p>Second &lt;one&gt; here.<p>Third one, not closed</article><footer>&copy; 2020</footer></body></html>",
              "A title & more\nFirst paragraph of the text, long enough.\nSecond <one> here.\nThird one, not closed"),
    "inside": ("<body><header><p>Site name and slogan</p></header><article><h1>Head line</h1><p>Some words of the story that go on.</p>"
               "<aside class='related'><p>Read this other story too</p></aside><p>The story ends after these words.</p>"
               "<section class='comments'><div class='comment'><p>I think this is a great story and I read all of it.</p></div></section></article>"
               "<form><label>Mail</label><input><button>Send</button></form></body>",
               "Head line\nSome words of the story that go on.\nThe story ends after these words."),
    "div": ("<div class='cookie-notice'><p>We use cookies on this site. Accept them all.</p></div><div id='sidebar'><ul><li><a href=/>x y</a></li></ul></div>"
            "<div class='entry-content'><p>Real text of a post, in a division.</p><ul><li>first item of a list</li><li>second item</li></ul><p>End of it.</p></div>"
            "<div class='advert'>Buy now</div><script>var x = '<p>no</p>';</script><style>p{}</style>",
            "Real text of a post, in a division.\nfirst item of a list\nsecond item\nEnd of it."),
    "header": ("<body><header class=masthead>My site <a href=/>Home</a></header><article><header class=entry-header><h1>The title of it</h1></header>"
               "<p>First long paragraph of the text here, with many words in it to be read.</p><p>Second <a href=/q>linked paragraph</a> of the "
               "text, which is long too.</p></article><footer>foot</footer></body>",
               "The title of it\nFirst long paragraph of the text here, with many words in it to be read.\n"
               "Second linked paragraph of the text, which is long too."),
    "bar": ("<body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></div><article><h1>The title of it</h1><p>First long paragraph "
            "of the text here, with many words in it to be read.</p><p>Second paragraph of the text, which is long too.</p></article></body>",
            "The title of it\nFirst long paragraph of the text here, with many words in it to be read.\nSecond paragraph of the text, which is long too."),
    "none": ("<nav><a href=/>Home</a></nav><footer>foot</footer>", ""),
    "empty": ("", ""),
}


@pytest.fixture(scope="module")
def trees(spark):
    return pagetext.fit(spark, words(random.Random(0), 400).split())


@pytest.mark.parametrize("limit", [1, 7, 30, 99, 500])
def test_sample_words_takes_the_smallest_hashes(spark, limit):
    d = spark.createDataFrame([(i % 60, f"<p>w{i % 60} {'x' * 50}</p>") for i in range(90)] + [(5, None)], "page_id long, html string").where("html is not null")
    got = [w for w in pagetext.sample_words(d, "page_id", "html", limit, 9) if w.startswith("w")]
    key = {r[0]: r[1] for r in d.selectExpr("page_id", "xxhash64(page_id)").distinct().collect()}
    ids = sorted(range(60), key=key.get)
    rows = [i for i in ids for _ in range(2 if i < 30 else 1)][:limit]
    assert got == [f"w{i}" for i in dict.fromkeys(rows)]
    assert pagetext.sample_words(d.limit(0), "page_id", "html", limit) == []


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(trees, name):
    assert pagetext.main_text(PAGES[name][0], trees) == PAGES[name][1]


@pytest.mark.parametrize("html", [
    "<html><head><title>no</title><meta charset=utf-8><article><p>after</p></article>", "<head><title>no</title>after", "<head><noscript>no<div>after",
    "<head><title>no<meta charset=utf-8><body>after", "<div><svg><path d=x>no</div><p>after</p>", "<svg><g><text>no</text><p>after</p>",
    "<p><object data=x>no</p>after", "<video src=x>no<p>after", "<p><iframe src=x>no<div>after", "<ul><li><canvas>no<li>after</ul><canvas>no</canvas>",
    "<object>no<p>no</p></object><p>after", "<head><noscript><img><div>no</div></noscript></head><p>after", "<ul><noscript><li>no</li></noscript></ul>after",
    "<svg><title>no</title><foreignObject><p>no</p></foreignObject></svg><p>after", "<script>'<p>no</p>'</script><p>after",
    "<div><template><tr><td>no</div>no</template>after", "<p><svg/>after"])
def test_silent_elements_left_open(html):
    assert "".join(piece for block in pagetext.Page(html).blocks for _, piece in block).strip() == "after"


def test_extract(spark, trees):
    long = "<article>" + "".join(f"<p>paragraph number {i} of a long page.</p>" for i in range(3000)) + "</article>"
    deep = "<article>" + "<div>" * 3000 + "<p>deep text in here, at last.</p>"
    rows = [(i, None if i % 2 else n, h, "x", 1.5) for i, (n, (h, _)) in enumerate(PAGES.items())] + [
        (9, "u", None, "x", 1.0), (9, "u", None, "x", 1.0), (None, None, PAGES["plain"][0], None, None), (10, "l", long, "", 0.0), (11, "d", deep, "", 0.0),
        (12, "b", "<<>< &#xZZ; <p <b", "", 0.0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, score double")
    got = pagetext.extract(d, trees=trees).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[9] == "" and by[None] == PAGES["plain"][1] and by[10].count("\n") == 2999
    assert pagetext.extract(d.limit(0)).count() == 0


def test_decode_has_no_contradictions(trees):
    page = pagetext.Page(PAGES["inside"][0])
    rng = np.random.default_rng(3)
    for _ in range(50):
        keep = pagetext.decode(page, rng.normal(size=len(page.nodes)))
        assert all(not keep[i] or keep[v.parent] for i, v in enumerate(page.nodes) if v.parent >= 0)


# --- substrings -------------------------------------------------------------------------------------------------

def brute_removal(rows, window):
    last = 1 << 62
    first = {}
    for r in rows:
        w = split(r[1])
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            first[s] = min(first.get(s, last), last if r[0] is None else r[0])
    out = collections.Counter()
    for r in rows:
        w = split(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (last if r[0] is None else r[0]):
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring(docs, rows):
    assert many(substring.removal_digests(docs)) == brute_removal(rows, 13)


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_substring_small_alphabet(spark, window):
    rng = random.Random(window)
    rows = [(rng.randint(0, 30), " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = collections.Counter((r["id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest())
                              for r in substring.remove_repeats(d, window=window, buckets=3).collect())
    assert got == brute_removal(rows, window)


# --- sharding ---------------------------------------------------------------------------------------------------

def test_sharding(docs, rows):
    got = sharding.shard_documents(docs).collect()
    check_shards(got, 24)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)


def check_shards(got, shards):
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
    sizes = [len(held[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(held) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in held.values())


def cut_groups(got):
    at = collections.defaultdict(set)
    for r in got:
        at[r["g"]].add(r["shard"])
    return {g: len(v) for g, v in at.items() if len(v) > 1}


@pytest.mark.parametrize("hot", [0, 200, 400])
def test_sharding_cuts_few_groups(spark, hot):
    rows = [(i, f"g{i // 3}") for i in range(300)] + [(1000 + i, "hot") for i in range(hot)] + [(2000 + i, f"s{i}") for i in range(100 if hot < 400 else 0)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, g string"), "g", ["doc_id"], 7).collect()
    check_shards(got, 7)
    assert set(cut_groups(got)) <= {"hot"}                    # every group that fits one shard lies in one


def test_sharding_with_no_unlinked_row_cuts_no_pair_or_triple(spark):
    rows = [(i, "hot") for i in range(2000)] + [(10_000 + i, f"f{i // 50}") for i in range(3400)]
    rows += [(20_000 + i, f"p{i // 2}") for i in range(236)] + [(30_000 + i, f"t{i // 3}") for i in range(366)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, g string"), "g", ["doc_id"], 24).collect()
    assert len(got) == 6002
    check_shards(got, 24)
    assert set(cut_groups(got)) <= {"hot"}


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_small_and_one_sided_tables(spark, shards):
    for rows in ([(i, "one") for i in range(40)], [(i, "ab"[i % 2]) for i in range(7)], [(i, None if i % 3 else f"g{i % 6}") for i in range(50)]):
        got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, g string"), "g", ["doc_id"], shards).collect()
        held = collections.Counter(r["shard"] for r in got)
        assert sorted(r["doc_id"] for r in got) == [d for d, _ in rows] and max(held) < shards
        assert max(held.values()) - (min(held.values()) if len(held) == shards else 0) <= 1


# --- decontamination --------------------------------------------------------------------------------------------

def test_decontamination(spark, docs, rows):
    rng = random.Random(9)
    items = [words(rng, n) for n in (15, 25, 40, 60)]
    edited = items[2].split()
    for k in range(4, 40, 9):
        edited[k] = "changed"
    edited.insert(20, "inserted")
    del edited[30]
    leaks = [(5000, words(rng, 200) + " " + items[0] + " " + words(rng, 90)), (5001, items[1].upper().replace(" ", ", ")),
             (5002, words(rng, 30) + " " + " ".join(edited) + " " + words(rng, 30)), (5003, items[3].replace(" ", "\n") + " " + items[0]), (5004, items[3][:60]),
             (5005, items[2]), (5005, items[2])]
    d = docs.select("doc_id", "text", "id", "key").unionByName(spark.createDataFrame([(i, t, 1, "k") for i, t in leaks], "doc_id long, text string, id long, key string"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, ""  , "x"), (11, "too short", "x"), (0, items[0], "x")],
                                  "item_id long, text string, words string")
    got = decontam.contaminated_documents(d, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(5000, 0), (5001, 1), (5002, 2), (5003, 0), (5003, 3), (5005, 2)]
    at = {(r["doc_id"], r["item_id"]): r for r in got}
    assert at[5000, 0]["score"] == 1.0 and at[5000, 0]["end_word"] - at[5000, 0]["first_word"] == 15 and at[5002, 2]["score"] < 1
    clean = decontam.drop_contaminated(d, bench)
    assert clean.columns == d.columns
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter([r[0] for r in rows] + [5004])


@pytest.mark.parametrize("copies", [15, 17, 1000])
def test_decontamination_edited_copies(spark, copies):
    """Seeds that many edited copies share lead to them, whatever else of the item a single verbatim copy keeps."""
    rng = random.Random(copies)
    item = [f"w{i}" for i in range(20)]
    edited = ["changed" if i in (5, 10, 15) else w for i, w in enumerate(item)]
    rows = [(0, words(rng, 40) + " " + " ".join(item) + " " + words(rng, 40))]
    rows += [(1 + i, words(rng, 40) + " " + " ".join(edited) + " " + words(rng, 40)) for i in range(copies)]
    rows += [(5000 + i, words(rng, 40) + " " + " ".join(item[:4]) + " " + words(rng, 40)) for i in range(30)]
    rows += [(6000 + i, rows[1][1]) for i in range(20)]
    got = decontam.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                                          spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["score"], r["first_word"], r["end_word"]) for r in got} == {
        0: (1.0, 40, 60), **{i: (0.775, 40, 60) for i in [*range(1, 1 + copies), *range(6000, 6020)]}}
    assert len(got) == copies + 21


def test_decontamination_short_items(spark):
    rng = random.Random(3)
    items = ["Paris", "blue whale", "forty two degrees", "日本の首都は東京です", "four words make seeds"]
    rows = [(i, f"{words(rng, 30)} {t.upper()}, {words(rng, 30)}") for i, t in enumerate(items)]
    rows += [(10, "blue"), (11, "whale blue"), (12, "forty two"), (13, "Blue\nwhale"), (14, "paris"), (15, "parisian"), (16, None)]
    got = decontam.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                          spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [*((i, i) for i in range(5)), (13, 1), (14, 0)]
    assert {r["score"] for r in got} == {1.0}
    assert {(r["first_word"], r["end_word"]) for r in got if r["doc_id"] == 2} == {(30, 33)}


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_align():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 20))] for _ in range(2))
        score, first, end = decontam.align(a, b)
        assert score == brute_align(a, b) == brute_align(a, b[first:end])


# --- empty tables -----------------------------------------------------------------------------------------------

def test_empty_tables(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    for made in (exact.exact_groups(nothing), exact.drop_exact_copies(nothing), simhash.fingerprint_groups(nothing), simhash.keep_one(nothing),
                 rans.file_digests(nothing, WORDS), bpe.digests(nothing, BPE, public_tokenizers.PATTERN), substring.removal_digests(nothing),
                 sharding.shard_documents(nothing), decontam.contaminated_documents(nothing, bench), decontam.contaminated_documents(docs, bench)):
        assert made.count() == 0
    assert decontam.drop_contaminated(docs, bench).count() == docs.count()


# --- pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [" ".join(x.decode() for x in decontam.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left, stages = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"t-{name}")
        stage(spark, left, sf).write.parquet(path)
        left = spark.read.parquet(path)
        stages.append({r["doc_id"]: r["text"] for r in left.collect()} if name != "byte_bpe" else {tuple(r) for r in left.collect()})
        if name != "byte_bpe":
            assert left.columns == docs.columns
    good, unique, apart, clean, tokens = stages
    score = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(good) == {i for i, p in score.items() if p}
    assert set(unique) == set({lower(t): i for i, t in sorted(good.items())}.values())
    ids = sorted(unique)
    assert set(apart) == {ids[c] for c in brute_components([brute_print(unique[i]) for i in ids], 4)}
    assert set(clean) == {i for i, t in apart.items()
                          if not any(f" {b} " in f" {b' '.join(decontam.words_of(t)).decode()} " for b in bench)}
    assert tokens == {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert {r[0] for r in tokens} == set(clean)


def test_new_words_are_encoded_by_the_model_alone(monkeypatch):
    chars = [chr(c) for c in range(0x180)]
    texts = [*chars, *[x + y for x in chars for y in ("a", "é", "\x01", "Ĳ9", "!")], "İx i̇ a\x7fb \x00\x01 ­"]
    t = Tokenizer.from_file(WORDS)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    enc = rans.WordEncoder(WORDS)
    plain = [x for x in texts if enc._cut(x) is not None]
    assert len(plain) > 2000
    monkeypatch.setattr(enc, "_ids", None)                       # the whole tokenizer is not called for them
    assert enc.encode(plain) == [w for x, w in zip(texts, want, strict=True) if x in set(plain)]


def test_each_distinct_word_of_many_texts_is_looked_up_once(spark, monkeypatch):
    t = Tokenizer.from_file(WORDS)

    def want(texts):
        return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

    long = "ab" * 50
    texts = ["Is it, is it\n", "", "it's  it é9 " * 300, f"{long}, it \x85is {long}", "<|endoftext|> is 中 it", "it"]
    enc, seen, found = rans.WordEncoder(WORDS), [], []
    places, find = enc._places, enc.find
    monkeypatch.setattr(enc, "_places", lambda words: seen.extend(words.to_pylist()) or places(words))
    monkeypatch.setattr(enc, "find", lambda w: found.append(w) or find(w))
    assert enc.encode(texts) == want(texts)
    assert sorted(seen) == sorted({"is", "it,", "it", "", "it's", "é9", f"{long},", "\x85is", long})
    found.clear()
    assert enc.encode(texts) == want(texts)
    assert sorted(found) == [long, f"{long},"]                    # only very long words are not remembered
    monkeypatch.setattr(rans, "CACHE", 2)
    assert enc.encode(["new is", *texts]) == want(["new is", *texts]) and "new" in enc.words.to_pylist()
    monkeypatch.setattr(rans, "PORTION", 20)                      # texts are dealt by bytes, longer ones go alone
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    crcs = {i: zlib.crc32(x + b"\1\0\0\0") for i, x in zip([*range(len(texts)), 9], want([*texts, ""]), strict=True)}
    assert {r[0]: r[1] for r in rans.tokenize(docs, WORDS).select("doc_id", "crc").collect()} == crcs
