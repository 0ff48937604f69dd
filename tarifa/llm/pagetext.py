"""Main text of web pages: gradient-boosted trees judge DOM nodes, a hierarchical decoding picks the subtrees."""

from __future__ import annotations

import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import smallest

SAMPLE_PAGES = 200       # bounds of the text that fills the training pages: of so many pages
SAMPLE_CHARS = 2000      # .. so many characters each
TRAIN_PAGES = 240
TREES, DEPTH, SEED = 12, 4, 7

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video title".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
KEPT = frozenset("script style template title".split())     # not ended by the end of a parent
FOREIGN, HTML_IN_FOREIGN = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td textarea tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("body button caption dd dt html legend li optgroup option select summary tbody td textarea tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
# Elements and attribute words that tell what a part of a page is for.
BAD_TAGS = frozenset("nav aside footer header form menu dialog button select textarea fieldset search".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising alert author banner bio breadcrumb breadcrumbs byline
comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus feedback foot footer footnav form gdpr
head header hidden links login masthead menu menubar message meta modal nav navbar navigation newsletter notice notification overlay
pager pagination popup print privacy promo promoted promotion rail recommended related replies reply respond response responses
search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar tools
topbar warning widget widgets""".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent page post postbody story text".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "kids", "own", "links", "n_links", "first", "attrs")

    def __init__(self, tag: str, parent: int, depth: int, attrs: list[str]):
        self.tag, self.parent, self.depth, self.attrs = tag, parent, depth, attrs
        self.kids: list[int] = []
        self.own = self.links = self.n_links = self.words = 0
        self.first = 0


def _attr_words(attrs) -> list[str]:
    out = []
    for k, v in attrs:
        if k in ("class", "id", "role", "aria-label", "itemprop") and v:
            out += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
        elif k == "hidden":
            out.append("hidden")
    return out


class Page(HTMLParser):
    """Block-level nodes (and inline ones with telling attributes) in page order, and the text blocks: each a list of
    (node, piece). White space stays as it is until a block is rendered."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1, 0, [])]
        self.stack: list[tuple[str, int]] = [("#page", 0)]     # open elements and the node each belongs to
        self.blocks: list[list[tuple[int, str]]] = []
        self.run: list[tuple[int, str]] = []
        self.silent: list[str] = []                            # open elements from the outermost silent one inward,
        self.marks: list[int] = []                             # and the places of the silent ones among them
        self.ends = Counter(m.lower() for m in re.findall(r"</([a-zA-Z]+)", html))   # end tags still to come
        self.link = 0
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self):
        if any(not piece.isspace() for _, piece in self.run):
            self.blocks.append(self.run)
        self.run = []

    def _pop(self, count: int):
        for _ in range(count):
            tag, _ = self.stack.pop()
            if tag == "a":
                self.link -= 1
            if tag in BLOCKS:
                self._flush()

    def _holds(self, tag: str) -> bool:
        """Whether the innermost open silent element can have the element that starts inside it."""
        at = self.marks[-1]
        kind = self.silent[at]
        if kind == "head":
            return tag in IN_HEAD
        if not self.ends[kind]:                                 # left open: ends where a block starts
            return tag not in BLOCKS
        if kind in ("title", "template"):
            return True
        if tag == "body" or kind in FOREIGN and tag in BLOCKS and HTML_IN_FOREIGN.isdisjoint(self.silent[at + 1:]):
            return False
        if tag in SIBLINGS and SCOPE[tag].isdisjoint(self.silent[at + 1:]):   # ends an open element around the silent one
            near = next((t for t, _ in reversed(self.stack) if t in SIBLINGS[tag] or t in SCOPE[tag]), None)
            return near not in SIBLINGS[tag]
        return True

    def _cut(self, at: int):
        del self.silent[at:]
        while self.marks and self.marks[-1] >= at:
            self.marks.pop()

    def handle_starttag(self, tag, attrs):
        while self.silent and not self._holds(tag):
            self._cut(self.marks[-1])
        if tag in SILENT or self.silent:
            if tag not in VOID:
                if tag in SILENT:
                    self.marks.append(len(self.silent))
                self.silent.append(tag)
            return
        if tag in BLOCKS:
            if tag in CLOSES_P:
                self._close_open({"p"}, {"button", "td", "th", "caption", "table"})
            if tag in SIBLINGS:
                self._close_open(SIBLINGS[tag], SCOPE[tag])
            self._flush()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.run.append((self.stack[-1][1], "\n"))
            return
        words = _attr_words(attrs)
        at = self.stack[-1][1]
        if tag in BLOCKS or any(w in BAD_WORDS for w in words):
            up = self.nodes[at]
            node = Node(tag, at, up.depth + 1, words)
            node.first = len(up.kids)
            up.kids.append(len(self.nodes))
            at = len(self.nodes)
            self.nodes.append(node)
        if tag == "a":
            self.link += 1
            self.nodes[at].n_links += 1
        self.stack.append((tag, at))

    def _close_open(self, tags, scope):
        """Close the innermost open element of ``tags`` unless one of ``scope`` stands in between."""
        last = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                last = i
            elif tag in scope or tag in BLOCKS and tag not in tags:
                break
        if last is not None:
            self._pop(len(self.stack) - last)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT:
            self.handle_endtag(tag)
        elif self.silent and self.silent[-1] == tag:
            self._cut(len(self.silent) - 1)

    def handle_endtag(self, tag):
        self.ends[tag] -= 1
        if tag in self.silent:
            at = len(self.silent) - 1
            while self.silent[at] != tag:
                at -= 1
            self._cut(at)
            return
        if tag in SILENT:
            return
        if self.silent:                                        # the end of a parent ends them too
            if not KEPT.isdisjoint(self.silent) or all(t != tag for t, _ in self.stack):
                return
            self._cut(0)
        for i in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[i][0]
            if open_tag == tag:
                self._pop(len(self.stack) - i)
                return
            if tag not in BLOCKS and open_tag in BLOCKS:
                return

    def handle_data(self, data):
        if self.silent == ["head"] and not data.isspace():
            self._cut(0)
        if not self.silent:
            at = self.stack[-1][1]
            self.run.append((at, data))
            node, n = self.nodes[at], len(data.strip())
            node.own += n
            node.words += data.count(" ") + 1 if n else 0
            if self.link:
                node.links += n


NAMES = ("p", "heading", "item", "division", "table", "good_tag", "bad_tag", "good_words", "bad_words", "good_up", "bad_up", "nearest",
         "good_near", "bad_near", "depth", "place", "siblings", "alike", "chars", "own", "link_share", "links", "density", "mean_block",
         "paragraphs", "kids", "before")


def features(page: Page) -> np.ndarray:
    """One row per node, by NAMES."""
    nodes = page.nodes
    n = len(nodes)
    chars, links, n_links, below, paras, textual = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        v = nodes[i]
        chars[i] += v.own
        links[i] += v.links
        n_links[i] += v.n_links
        below[i] += 1
        paras[i] += v.tag == "p"
        textual[i] += v.own > 0
        if v.parent >= 0:
            for t in (chars, links, n_links, below, paras, textual):
                t[v.parent] += t[i]
    total = max(1, chars[0])
    out = np.zeros((n, len(NAMES)))
    near = [(0, 0, 0, 0, 0)] * n                       # good and bad ancestors, sign of the nearest, steps to either
    seen = 0
    for i, v in enumerate(nodes):
        good = sum(w in GOOD_WORDS for w in v.attrs)
        bad = sum(w in BAD_WORDS for w in v.attrs)
        gt, bt = v.tag in GOOD_TAGS, v.tag in BAD_TAGS
        g, b, sign, gd, bd = near[v.parent] if v.parent >= 0 else (0, 0, 0, 9, 9)
        up_g, up_b = g, b
        gd, bd = min(9, gd + 1), min(9, bd + 1)
        if bad or bt:
            b, sign, bd = b + 1, -1, 0
        elif good or gt:
            g, sign, gd = g + 1, 1, 0
        near[i] = (g, b, sign, gd, bd)
        kin = nodes[v.parent].kids if v.parent >= 0 else [i]
        alike = sum(nodes[k].tag == v.tag for k in kin[max(0, v.first - 5):v.first + 6])
        out[i] = (v.tag == "p", v.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), v.tag in ("li", "dt", "dd"), v.tag in ("div", "section"),
                  v.tag in ("table", "tr", "td", "th", "tbody"), gt, bt, min(good, 3), min(bad, 3), min(up_g, 3), min(up_b, 3), sign, gd, bd,
                  min(v.depth, 20), v.first / max(1, len(kin)), np.log1p(len(kin)), alike, np.log1p(chars[i]), np.log1p(v.own),
                  links[i] / max(1, chars[i]), np.log1p(n_links[i]), np.log1p(chars[i] / below[i]), np.log1p(chars[i] / max(1, textual[i])),
                  np.log1p(paras[i]), np.log1p(len(v.kids)), seen / total)
        seen += v.own
    return out


class Trees:
    """A fitted Spark GBT as arrays: one row per tree, complete binary trees by level."""

    def __init__(self, model):
        size = 2 ** (DEPTH + 1) - 1
        self.feature = np.zeros((len(model.treeWeights), size), np.int64)
        self.cut = np.full(self.feature.shape, np.inf)
        self.value = np.zeros(self.feature.shape)

        def fill(t, i, node):
            self.value[t, i] = node.prediction()
            if node.getClass().getSimpleName() == "InternalNode":
                self.feature[t, i], self.cut[t, i] = node.split().featureIndex(), node.split().threshold()
                fill(t, 2 * i + 1, node.leftChild())
                fill(t, 2 * i + 2, node.rightChild())
            elif 2 * i + 2 < size:                       # a leaf above the last level: both sides lead to its value
                fill(t, 2 * i + 1, node)
                fill(t, 2 * i + 2, node)

        for t, (tree, weight) in enumerate(zip(model._java_obj.trees(), model.treeWeights, strict=True)):
            fill(t, 0, tree.rootNode())
            self.value[t] *= weight

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Half the log odds that a node belongs to the main text."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > cut[at])
            out += value[at]
        return out


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """Which nodes stay. A node stays only below a node that stays; the choice maximises the sum of the margins, each
    weighted by the text that stands directly in its node. So a strong container outvotes a doubtful paragraph in it, a
    rejected container takes all it holds, and no child outlives its parent."""
    nodes = page.nodes
    worth = [float(m) * (1 + np.log1p(v.own)) for m, v in zip(margin, nodes, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and worth[i] > 0
    return keep


def main_text(html: str | None, trees: Trees) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    keep = decode(page, trees.margin(features(page)))
    blocks = (" ".join("".join(piece for node, piece in block if keep[node]).split()) for block in page.blocks)
    return "\n".join(b for b in blocks if b)


def _training_page(words: list[str], rng: random.Random) -> tuple[str, str]:
    """A made-up page from the given words and the letter that marks each text: m main, b boilerplate."""
    def text(lo, hi):
        return " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))

    def links(lo, hi):
        return "".join(f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi)))

    def mark(kind, inner):
        return f"<i{kind}>{inner}</i{kind}>"

    def paras(lo, hi, a=5, e=80):
        return "".join(rng.choice([f"<p>{text(a, e)}</p>"] * 5 + [f'<p>{text(a, e)} <a href="/x">{text(1, 4)}</a> {text(a, e)}</p>'] * 2
                                  + [f"<p><b>{text(a, e)}<br><p>{text(a, e)}</p>"] * 2) for _ in range(rng.randint(lo, hi)))

    def boiler():
        kind = rng.choice(["nav", "menu", "footer", "header", "aside", "ad", "notice", "form", "comments", "related", "social"])
        name = rng.choice(sorted({"nav": {"nav", "menu", "navbar"}, "menu": {"menu", "breadcrumb"}, "footer": {"footer", "copyright"},
                                  "header": {"header", "masthead", "banner"}, "aside": {"sidebar", "widget", "rail"},
                                  "ad": {"ad", "advert", "sponsored", "promo"}, "notice": {"notice", "cookie", "alert", "consent"},
                                  "form": {"form", "newsletter", "login", "search"}, "comments": {"comments", "replies", "discussion"},
                                  "related": {"related", "recommended"}, "social": {"share", "social"}}[kind]))
        tag = {"nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form"}.get(kind, "div")
        tag, attr = rng.choice([(tag, ""), (tag, f' class="{name}"'), ("div", f' class="{name}"'), ("section", f' id="{name}-1"'),
                                ("div", f' class="box {name}"')] if tag != "div" else
                               [("div", f' class="{name}"'), ("section", f' id="{name}"'), ("div", f' class="{name}-box"')])
        if kind in ("nav", "menu", "related", "social"):
            inner = f"<ul>{links(2, 9)}</ul>"
            if rng.random() < 0.3:                        # a bar of links, with no list and perhaps no name
                gap = rng.choice([" ", " | ", " · ", ""])
                inner = gap.join(f'<a href="/x">{text(1, 3)}</a>' for _ in range(rng.randint(2, 9)))
                tag, attr = rng.choice([(tag, attr), ("div", ""), ("p", "")])
        elif kind == "comments":
            inner = "".join(f'<div class="{rng.choice(["comment", "reply", "item"])}"><p>{text(3, 40)}</p></div>' for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{text(1, 4)}</label><input><button>{text(1, 2)}</button>"
        else:
            inner = rng.choice([text(3, 25), paras(1, 4, 3, 40), f"<p>{text(2, 20)} <a href='/'>{text(1, 3)}</a></p>"])
        return mark("0", f"<{tag}{attr}>{inner}</{tag}>")

    def extra():
        return rng.choice([f"<ul>{''.join(f'<li>{text(3, 25)}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<h2>{text(2, 8)}</h2>",
                           f"<blockquote><p>{text(5, 40)}</p></blockquote>", f"<table><tr><td>{text(1, 6)}</td><td>{text(1, 6)}</td></tr></table>",
                           f"<p>{text(1, 4)}</p>", f"<pre>{text(3, 30)}</pre>", f"<div><p>{text(5, 60)}</p></div>"])

    title = f"<h1>{text(2, 14)}</h1>"
    if rng.random() < 0.25:                               # a title of the article in a header of its own
        title = rng.choice([f"<header>{title}</header>", f'<header class="{rng.choice(["entry-header", "title", "post-header"])}">{title}</header>',
                            f"<header>{title}<p>{text(3, 20)}</p></header>"])
    body = [title] if rng.random() < 0.8 else []
    for _ in range(rng.choice([0, 1, 2, 4, 8])):
        body.append(paras(1, 4))
        if rng.random() < 0.3:
            body.append(extra())
        if rng.random() < 0.15:
            body.append(boiler())
    body.append(paras(0, 2, 1, 30))
    name = rng.choice(["content", "post", "entry", "article-body", "main-content", "story"])
    opening, closing = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                                   ("<main><article>", "</article></main>"), (f'<div class="{name}">', "</div>"),
                                   (f'<div id="wrapper"><div class="{name}">', "</div></div>"), ("<div>", "</div>"), ("", "")])
    main = mark("1", opening + "".join(body) + closing)
    if rng.random() < 0.1:
        main = mark("1", opening + "".join(body))         # cut off
        return "<html><body>" + "".join(boiler() for _ in range(rng.randint(1, 3))) + main
    return ("<!DOCTYPE html><html><body>" + "".join(boiler() for _ in range(rng.randint(0, 4))) + main
            + "".join(boiler() for _ in range(rng.randint(0, 4))) + "</body></html>")


class _Marked(Page):
    """Training page: elements i0 and i1 mark boilerplate and main text, and leave no trace in the tree."""

    def __init__(self, html: str):
        self.open: list[int] = []
        self.label: dict[int, int] = {}
        super().__init__(html)

    def handle_starttag(self, tag, attrs):
        if tag in ("i0", "i1"):
            self._close_open({"p"}, {"td"})
            self._flush()
            self.open.append(int(tag[1]))
            return
        before = len(self.nodes)
        super().handle_starttag(tag, attrs)
        for i in range(before, len(self.nodes)):
            self.label[i] = self.open[-1] if self.open else -1

    def handle_endtag(self, tag):
        if tag in ("i0", "i1"):
            if self.open:
                self.open.pop()
            return
        super().handle_endtag(tag)


def fit(spark: SparkSession, words: list[str], pages: int = TRAIN_PAGES) -> Trees:
    """Boosted trees (Spark ML) from made-up pages of known layout, filled with the given words."""
    rng, rows = random.Random(SEED), []
    words = words or ["text"]
    for _ in range(pages):
        page = _Marked(_training_page(words, rng))
        x = features(page)
        rows += [(x[i].tolist(), float(y)) for i, y in page.label.items() if y >= 0]
    d = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
    d = d.select(array_to_vector("x").alias("features"), "label").persist()
    try:
        return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(d))
    finally:
        d.unpersist()


def sample_words(pages: DataFrame, id_col: str, html_col: str, limit: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Words of at most ``limit`` pages, those with the smallest hashes of their id, ``chars`` characters of each. They are
    chosen from the ids alone; only their html is then read and stripped. Of rows with one id one is taken; null html has
    no words."""
    h = F.col(html_col).cast("string")
    hashed = smallest(pages.select(F.xxhash64(F.col(id_col)).alias("r"), h.alias("h")), "r", limit).where("h is not null")
    some = (hashed.select("r", F.substring(F.regexp_replace("h", r"(?s)<(script|style)\b.*?</|<[^>]*>|[<>]", " "), 1, chars).alias("t"))
            .groupBy("r").agg(F.min("t").alias("t")).collect())                              # at most ``limit`` rows
    return [w for r in sorted(some) for w in r["t"].split()]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """One row per page: id, url, text.

    The whole html is parsed; character references are decoded; elements left open or closed out of order are repaired.
    White space within a block becomes one space, blocks are trimmed and joined by one newline in page order. A page
    without main text, or with null or empty html, has an empty text. Repeated rows stay; extra columns are ignored; an
    empty table gives no rows."""
    trees = trees or fit(pages.sparkSession, sample_words(pages, id_col, html_col))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h, trees) for h in b.column(2).to_pylist()], pa.string())],
                                             names=[id_col, url_col, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return (pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))
            .mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string"))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
