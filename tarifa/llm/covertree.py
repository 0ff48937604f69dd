"""Exact top-k search by inner product: dual-tree search over cover trees of blocks.

Equal vectors are one point with the smallest ids that hold it, as many as an answer can name. Points are dealt to the
nearest of some pivots (a farthest-first order, the top of a cover tree over a bounded sample), then cut into blocks of
bounded size, and each block becomes a cover tree: a node's children lie within half its radius of their centres and
their centres further apart than that. Query points form blocks and trees of the same kind. For a query node with
centre q and covering radius s, and a node with centre r and radius t, no product exceeds

    q.r + |q| t + |r| s + s t ,

so a pair of blocks, and then a pair of nodes, goes once this lies below the worst k-th score of the queries in the
node. The first round searches each query block's most promising block, which gives those scores; the second searches
every pair of blocks that they leave over. All points are indexed and the answer is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import extent, matrix, packed_type, scaled

FACTOR = 256
TOP = 5
QUERY_EVERY = 50
MOST = 1 << 40           # scaled entries are held within this
BLOCK = 4096             # points of a block
QUERY_BLOCK = 512        # query points of a block
LEAF = 64                # points of a leaf
SAMPLE = 2048            # points that the pivots are chosen from; their number does not grow with the data
PIVOTS = 1024
GROUP = 256              # block outlines that are compared with a query block at a time
POOR = 16                # centres in a row that cover next to nothing before the rest of a node is cut into leaves
NO_ID = np.iinfo(np.int64).max


# --- cover tree of a block -------------------------------------------------------------------------------------

class Tree:
    """order: places of the block's points, node by node; node i holds order[lo[i]:hi[i]], its centre is the first of
    them, all lie within radius[i] of it, its children are kids[first[i]:first[i] + count[i]] (none: a leaf)."""

    def __init__(self, m: np.ndarray):
        self.order, self.lo, self.hi, self.radius, self.kids, self.first, self.count = [], [], [], [], [], [], []
        if len(m):
            self._grow(m, np.arange(len(m)))
        self.order = np.array(self.order, np.int64)
        for name, kind in (("lo", np.int64), ("hi", np.int64), ("radius", float), ("first", np.int64), ("count", np.int64)):
            setattr(self, name, np.array(getattr(self, name), kind))

    def packed(self) -> bytes:
        nodes = np.column_stack([self.lo, self.hi, self.radius, self.first, self.count])
        return len(nodes).to_bytes(8, "little") + nodes.tobytes() + np.array(self.kids, np.int64).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        """The tree of rows that stand in tree order."""
        tree, n = cls(np.zeros((0, 1))), int.from_bytes(raw[:8], "little")
        nodes = np.frombuffer(raw, float, n * 5, 8).reshape(n, 5)
        tree.lo, tree.hi, tree.first, tree.count = (nodes[:, i].astype(np.int64) for i in (0, 1, 3, 4))
        tree.radius, tree.kids = nodes[:, 2], np.frombuffer(raw, np.int64, offset=8 + n * 40).tolist()
        return tree

    def _node(self, radius: float) -> int:
        for name, value in (("lo", len(self.order)), ("hi", 0), ("radius", radius), ("first", 0), ("count", 0)):
            getattr(self, name).append(value)
        return len(self.lo) - 1

    def _grow(self, m, places):
        """Nodes of all points, by an explicit stack: (places, node above, its last child)."""
        stack, kids = [(places, -1, None)], {}
        while stack:
            at, above, last = stack.pop()
            if at is None:                       # all below this node is in the order
                self.hi[above] = len(self.order)
                continue
            away = np.sqrt(((m[at] - m[at[0]]) ** 2).sum(axis=1))
            node = self._node(float(away.max()) * (1 + 1e-12))
            if above >= 0:
                kids.setdefault(above, []).append(node)
            if len(at) <= LEAF or not away.any():
                self.order += at.tolist()
                self.hi[node] = len(self.order)
                continue
            stack.append((None, node, None))
            stack += [(p, node, None) for p in reversed(_cover(m, at, away))]
        for node, own in kids.items():
            self.first[node], self.count[node] = len(self.kids), len(own)
            self.kids += own


def _cover(m: np.ndarray, at: np.ndarray, away: np.ndarray) -> list:
    """The children of a node: its points dealt to centres that cover half its radius, the first centre being the node's own.
    Small children share leaves, and so do the rest once POOR centres in a row have covered next to nothing."""
    half, out, small, poor = away.max() / 2, [], [], 0
    while len(at):
        near = away <= half
        own = at[near]
        if len(own) > LEAF // 4:
            out.append(own)
            poor = 0
        else:
            small.append(own)
            poor += 1
        at = at[~near]
        if poor >= POOR:
            break
        if len(at):
            away = np.sqrt(((m[at] - m[at[0]]) ** 2).sum(axis=1))
    if len(at):
        small.append(at[np.argsort(((m[at] - m[at[0]]) ** 2).sum(axis=1), kind="stable")])
    rest = np.concatenate(small) if small else np.zeros(0, np.int64)
    return out + [rest[i:i + LEAF] for i in range(0, len(rest), LEAF)]


# --- dual-tree search of two blocks ----------------------------------------------------------------------------

def bounds(q, q_norm, q_radius, r, r_norm, r_radius):
    """What no product of a point of the one node and a point of the other exceeds, rounding included."""
    b = q @ r.T + np.outer(q_norm, r_radius) + np.outer(q_radius, r_norm) + np.outer(q_radius, r_radius)
    return b + 1e-9 * (np.outer(q_norm + q_radius, r_norm + r_radius) + 1)


def search(q: np.ndarray, q_tree: Tree, r: np.ndarray, r_tree: Tree, ids: np.ndarray, k: int, floor: np.ndarray):
    """(scores, ids, pairs of points compared): for each row of ``q`` (in tree order) the ``k`` best (score, then smaller id) of the
    ids that the rows of ``r`` (in tree order) hold, among scores of at least ``floor``; ``ids`` is padded with NO_ID. Entries are
    whole numbers whose products are exact in doubles. Missing answers have score -inf."""
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), NO_ID)
    floor, compared = floor.astype(float).copy(), 0
    q_norm, r_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1))
    qn, rn = np.array([0]), np.array([0])
    while len(qn):
        qc, rc = q_tree.lo[qn], r_tree.lo[rn]
        s, t = q_tree.radius[qn], r_tree.radius[rn]
        top = (q[qc] * r[rc]).sum(axis=1) + q_norm[qc] * t + r_norm[rc] * s + s * t
        top = top + 1e-9 * ((q_norm[qc] + s) * (r_norm[rc] + t) + 1)
        leaf = (q_tree.count[qn] == 0) & (r_tree.count[rn] == 0)
        for i in np.flatnonzero(leaf)[np.argsort(-top[leaf], kind="stable")]:
            a, b, c, d = q_tree.lo[qn[i]], q_tree.hi[qn[i]], r_tree.lo[rn[i]], r_tree.hi[rn[i]]
            if top[i] < floor[a:b].min():
                continue
            compared += int((b - a) * (d - c))
            score = q[a:b] @ r[c:d].T
            rows = np.flatnonzero((score >= floor[a:b, None]).any(axis=1))
            if not len(rows):
                continue
            wide = max(1, int((ids[c:d] != NO_ID).sum(axis=1).max()))
            own = ids[c:d, :wide].ravel()
            new = np.where(own == NO_ID, -np.inf, np.repeat(score[rows], wide, axis=1))
            both = np.concatenate([best[a + rows], new], axis=1)
            name = np.concatenate([who[a + rows], np.broadcast_to(own, new.shape)], axis=1)
            at = np.lexsort((name, -both), axis=-1)[:, :k]
            best[a + rows], who[a + rows] = np.take_along_axis(both, at, 1), np.take_along_axis(name, at, 1)
            floor[a:b] = np.maximum(floor[a:b], best[a:b, k - 1])
        worst = np.array([floor[q_tree.lo[n]:q_tree.hi[n]].min() for n in np.unique(qn)])
        keep = ~leaf & (top >= worst[np.searchsorted(np.unique(qn), qn)])
        next_q, next_r = [], []
        for a, b, wide_q, wide_r in zip(qn[keep], rn[keep], s[keep], t[keep], strict=True):
            if q_tree.count[a] and (not r_tree.count[b] or wide_q > wide_r):      # the wider node is opened
                own = q_tree.kids[q_tree.first[a]:q_tree.first[a] + q_tree.count[a]]
                next_q += own
                next_r += [b] * len(own)
            else:
                own = r_tree.kids[r_tree.first[b]:r_tree.first[b] + r_tree.count[b]]
                next_q += [a] * len(own)
                next_r += own
        qn, rn = np.array(next_q, np.int64), np.array(next_r, np.int64)
    short = best < floor[:, None]                 # below what other blocks offer
    best[short], who[short] = -np.inf, NO_ID
    return best, who, compared


# --- points, pivots and blocks ---------------------------------------------------------------------------------

def _points(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, query): each distinct vector, the ``k`` smallest ids that hold it, repeats included, and whether a query holds it. A batch's
    equal vectors are put together before the shuffle, so a vector of many rows sends a few ids a batch."""
    def merge(batches):
        for b in batches:
            held: dict[bytes, list] = {}
            for i, v, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = held.setdefault(v, [[], False])
                own[0].append(i)
                own[1] |= q
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x[0])[:k] for x in held.values()], pa.list_(pa.int64())),
                                              pa.array([x[1] for x in held.values()], pa.bool_())], names=["v", "ids", "query"])

    return (rows.mapInArrow(merge, "v binary, ids array<long>, query boolean").groupBy("v")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"), F.max("query").alias("query")))


def pivot_order(m: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` rows, each the farthest from those before it: every prefix is a cover of the rows."""
    if not len(m):
        return np.zeros(0, np.int64)
    out, far = [0], ((m - m[0]) ** 2).sum(axis=1)
    while len(out) < most and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((m - m[out[-1]]) ** 2).sum(axis=1))
    return np.array(out)


def _dealt(points: DataFrame, pivots: np.ndarray, kind: str, size: int) -> DataFrame:
    """``points`` with ``block``: a number (pivot, part) so that blocks hold about ``size`` points near one pivot."""
    spark, width = points.sparkSession, pivots.shape[1]
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches):
        p = shared.value
        half = (p * p).sum(axis=1) / 2
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                m = np.frombuffer(b"".join(part.column(0).to_pylist()), kind).reshape(-1, width).astype(float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((m @ p.T - half).argmax(axis=1).astype(np.int32))],
                                                 names=[*part.schema.names, "pivot"])

    dealt = checkpoint(points.mapInArrow(nearest, "v binary, ids array<long>, query boolean, pivot int"))
    counts = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}   # at most PIVOTS rows
    parts = [-(-counts.get(i, 0) // size) or 1 for i in range(len(pivots))]
    first = np.cumsum([0, *parts[:-1]]).tolist()
    take = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.col("pivot") + 1)
    return dealt.withColumn("block", take(first) + F.pmod(F.xxhash64("v"), take(parts)))


def _blocks(dealt: DataFrame, kind: str, width: int, k: int, size: int) -> DataFrame:
    """One row per block: block, n, centre, radius, norm (of the centre), floor (the least of floors), rows (packed matrix in tree order),
    tree, ids (padded, in tree order), floors (a score per row that the answer must reach)."""
    schema = "block long, n long, centre array<double>, radius double, norm double, floor double, rows binary, tree binary, ids binary, floors binary"

    def build(t: pa.Table) -> pa.Table:
        raw = b"".join(t["v"].to_pylist())
        x = np.frombuffer(raw, kind).reshape(-1, width)
        m = x.astype(float)
        tree = Tree(m)
        ids = np.full((len(m), k), NO_ID)
        for i, own in enumerate(t["ids"].to_pylist()):
            ids[i, :len(own)] = own
        c = m[tree.order[0]]
        return pa.Table.from_pydict(
            {"block": pa.array([t["block"][0].as_py()], pa.int64()), "n": pa.array([len(m)], pa.int64()), "centre": pa.array([c.tolist()], pa.list_(pa.float64())),
             "radius": [float(tree.radius[0])], "norm": [float(np.sqrt(c @ c))], "floor": [float("-inf")],
             "rows": pa.array([x[tree.order].tobytes()], pa.binary()), "tree": pa.array([tree.packed()], pa.binary()), "ids": pa.array([ids[tree.order].tobytes()], pa.binary()),
             "floors": pa.array([np.full(len(m), -np.inf).tobytes()], pa.binary())})

    # ``size`` bounds what one group holds, give or take the spread of a hash
    return dealt.select("block", "v", "ids").groupBy("block").applyInArrow(build, schema)


def _pairs(q: DataFrame, r: DataFrame, count: int) -> DataFrame:
    """(q_block, r_block, bound, near) for every query block and block, from their outlines: ``count`` blocks in groups of about GROUP,
    each group one row, met by each query block on the group's number."""
    groups = -(-count // GROUP)

    def join_up(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        return pa.Table.from_pydict({"g": pa.array([t["g"][0].as_py()], pa.int64()), "blocks": pa.array([t["block"].to_pylist()], pa.list_(pa.int64())),
                                     "centres": pa.array([np.array(t["centre"].to_pylist()).tobytes()], pa.binary()),
                                     "norms": pa.array([t["norm"].to_pylist()], pa.list_(pa.float64())),
                                     "radii": pa.array([t["radius"].to_pylist()], pa.list_(pa.float64()))})

    outlines = (r.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long").alias("g"), "block", "centre", "norm", "radius")
                .groupBy("g").applyInArrow(join_up, "g long, blocks array<long>, centres binary, norms array<double>, radii array<double>"))
    asked = q.select("block", "centre", "norm", "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def bound(batches):
        for b in batches:
            for block, c, norm, radius, blocks, centres, norms, radii in zip(*[x.to_pylist() for x in b.columns], strict=True):
                c, centres = np.array([c]), np.frombuffer(centres).reshape(len(blocks), -1)
                top = bounds(c, np.array([norm]), np.array([radius]), centres, np.array(norms), np.array(radii))[0]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(top), pa.array(centres @ c[0])],
                                                 names=["q_block", "r_block", "bound", "near"])

    met = asked.join(outlines, "g").select("block", "centre", asked["norm"], asked["radius"], "blocks", "centres", "norms", "radii")
    return met.mapInArrow(bound, "q_block long, r_block long, bound double, near double")


def _answers(pairs: DataFrame, q: DataFrame, r: DataFrame, kind: str, width: int, k: int) -> DataFrame:
    """(q_block, place, score, id): the answers of each pair of blocks that reach the floors of the query block."""
    def block(rows, tree):
        return np.frombuffer(rows, kind).reshape(-1, width).astype(float), Tree.unpacked(tree)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, q_rows, q_tree, floors, r_rows, r_tree, ids = [c[i].as_py() for c in b.columns]
                (qm, qt), (rm, rt) = block(q_rows, q_tree), block(r_rows, r_tree)
                score, who, _ = search(qm, qt, rm, rt, np.frombuffer(ids, np.int64).reshape(-1, k), k, np.frombuffer(floors))
                at, col = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int64)), pa.array(at), pa.array(score[at, col].astype(np.int64)), pa.array(who[at, col])],
                                                 names=["q_block", "place", "score", "id"])

    met = (pairs.select("q_block", "r_block")
           .join(r.select(F.col("block").alias("r_block"), F.col("rows").alias("r_rows"), F.col("tree").alias("r_tree"), "ids"), "r_block")
           .join(q.select(F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("tree").alias("q_tree"), "floors"), "q_block")
           .select("q_block", "q_rows", "q_tree", "floors", "r_rows", "r_tree", "ids"))
    return met.mapInArrow(run, "q_block long, place long, score long, id long")


def _best(answers: DataFrame, k: int) -> DataFrame:
    """(q_block, place, top): the ``k`` best answers of each query point, best first."""
    from pyspark.sql import Window
    w = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "id")
    return (answers.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).groupBy("q_block", "place")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("top")))


def _with_floors(q: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The query blocks with the k-th score found so far as each row's floor."""
    names = q.columns

    def fill(batches):
        for b in batches:
            out = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            floors, least = [], []
            for old, found in zip(out["floors"].to_pylist(), out["found"].to_pylist(), strict=True):
                f = np.frombuffer(old).copy()
                for x in found or []:
                    f[x["place"]] = x["kth"]
                floors.append(f.tobytes())
                least.append(float(f.min()))
            out["floors"], out["floor"] = pa.array(floors, pa.binary()), pa.array(least, pa.float64())
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    kth = (best.where(F.size("top") == k).select("q_block", F.struct("place", (-F.col("top")[k - 1]["less"]).cast("double").alias("kth")).alias("x"))
           .groupBy("q_block").agg(F.collect_list("x").alias("found")))      # at most the rows of a query block
    return q.join(kth.withColumnRenamed("q_block", "block"), "block", "left").select(*q.columns, "found").mapInArrow(fill, q.schema)


def top_scores(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = QUERY_EVERY,
               factor: int = FACTOR, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` the ``k`` highest inner products of
    floor(factor * vector) with all other rows, ties to the smaller id; all other rows if there are fewer.

    Left out: rows with a null id, and vectors that are null or hold a null or non-finite entry. A vector shorter than the
    longest counts as followed by zeros. Scaled entries are held within 2^40, and vectors so long that a product could reach
    2^53 raise ValueError. Repeated rows are rows of their own: each is a query and a candidate of the others, under the same
    id. An empty table gives no rows. Extra columns are ignored.

    ``sample``: about so many points, picked by hash, choose the pivots; every point is indexed and the answer does not depend on it."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    schema = "query_id long, rank int, vec_id long, score long"
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    rows, width, top = extent(df, "vec", factor, MOST)
    if not rows:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    if width * top * top >= 1 << 53:
        raise ValueError("products of these vectors do not fit the exact range of doubles")
    kind, most = packed_type(top), k + 1          # a query's own row is among the best k + 1

    def scale(batches):
        for b in batches:
            at, m = matrix(b.column(1), width)
            v = scaled(m, factor, MOST).astype(kind)
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in v], pa.binary()), pa.array(ids.to_numpy() % every == 0)], names=["id", "v", "query"])

    own = df.mapInArrow(scale, "id long, v binary, query boolean")
    points = checkpoint(_points(own, most))
    n, asked = points.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    if not asked:
        return spark.createDataFrame([], schema)

    def pivots(part, count, size):                # the sample is cut by hash, so no task hands on more than its share
        share = min(1.0, sample / count)
        got = part.where(F.pmod(F.xxhash64("v"), F.lit(1 << 32)) < int(share * (1 << 32))).select("v").collect() or part.select("v").limit(1).collect()
        m = np.frombuffer(b"".join(sorted(bytes(r["v"]) for r in got)), kind).reshape(-1, width).astype(float)
        return m[pivot_order(m, max(1, min(PIVOTS, -(-count // size))))]

    r = checkpoint(_blocks(_dealt(points, pivots(points, n, BLOCK), kind, BLOCK), kind, width, most, BLOCK))
    questions = points.where("query")
    q = checkpoint(_blocks(_dealt(questions, pivots(questions, asked, QUERY_BLOCK), kind, QUERY_BLOCK), kind, width, most, QUERY_BLOCK))
    pairs = checkpoint(_pairs(q, r, r.count()))
    home = pairs.groupBy("q_block").agg(F.max_by("r_block", F.struct("near", "r_block")).alias("r_block"))
    first = checkpoint(_answers(home, q, r, kind, width, most))
    q = checkpoint(_with_floors(q, _best(first, most), most))
    left = (pairs.join(home.select("q_block", F.col("r_block").alias("home")), "q_block").where("r_block <> home")
            .join(q.select(F.col("block").alias("q_block"), "floor"), "q_block").where("bound >= floor"))
    answers = first.unionByName(_answers(left, q, r, kind, width, most))
    best = _best(answers, most)

    def name(batches):                            # the vector of each place of a query block
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size = len(raw) // (np.dtype(kind).itemsize * width)
                v = [raw[i * len(raw) // size:(i + 1) * len(raw) // size] for i in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array(v, pa.binary())],
                                                 names=["q_block", "place", "v"])

    by_vector = checkpoint(best.join(q.select("block", "rows").mapInArrow(name, "q_block long, place long, v binary"), ["q_block", "place"])
                           .select(F.col("v").alias("key"), "top"))
    # each query row takes the answers of its vector, less one that bears its own id and its own product
    met = own.where("query").join(by_vector, F.col("v") == F.col("key")).select("id", "v", "top")

    def answer(batches):
        for b in batches:
            out = [[], [], [], []]
            for i, v, top_ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.frombuffer(v, kind).astype(object)
                mine, rank = (-int((x * x).sum()), i), 0
                for t in top_:
                    if mine == (t["less"], t["id"]):
                        mine = None
                        continue
                    if rank == k:
                        break
                    rank += 1
                    for c, value in zip(out, (i, rank, t["id"], -t["less"]), strict=True):
                        c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                                             names=["query_id", "rank", "vec_id", "score"])

    return met.mapInArrow(answer, schema)
