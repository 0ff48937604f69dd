"""Symbolic features by genetic programming.

Programs are expression trees over the input columns, constants and the protected operators (E17). Each generation
scores its whole population in ONE pass over the rows: a task evaluates every program on blocks of rows as NumPy vectors
(equal subtrees once, none kept after its last use) and keeps centred co-moments with the target, which are merged task by task; the driver sees five
numbers a program. Parents win tournaments; a child is a subtree crossover of two, or a subtree, hoist or point mutation
of one. The fittest distinct programs of the last generation form the hall of fame; of its most correlated pair the less
fit one leaves until ``n_keep`` are left. ``transform`` writes them as plain Column formulas.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PSYM, psym, sanitize
from .moments import FAN_IN, co_moments
from .quantiles import exact_median_values
from .relational import key_hash

BLOCK = 2048          # rows evaluated together, fewer where more than HELD_BYTES would be kept of their values
HELD_BYTES = 1 << 25
_GUARD = 0.001        # as in PSYM; a NaN passes the guard there, so it does here
_NUMPY = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply,
    "div": lambda a, b: np.where(np.abs(b) <= _GUARD, 1.0, a / np.where(np.abs(b) <= _GUARD, 1.0, b)),
    "log": lambda a: np.where(np.abs(a) <= _GUARD, 0.0, np.log(np.where(np.abs(a) <= _GUARD, 1.0, np.abs(a)))),
    "sqrt": lambda a: np.sqrt(np.abs(a)), "sin": np.sin, "cos": np.cos,
}


def formula(tree) -> str:
    if isinstance(tree, tuple):
        return f"{tree[0]}({', '.join(formula(a) for a in tree[1:])})"
    return tree if isinstance(tree, str) else f"{tree:.6f}"


def size(tree) -> int:
    return 1 + sum(size(a) for a in tree[1:]) if isinstance(tree, tuple) else 1


def as_column(tree, inputs: dict) -> Column:
    if isinstance(tree, tuple):
        return psym(tree[0], *[as_column(a, inputs) for a in tree[1:]])
    return inputs[tree] if isinstance(tree, str) else F.lit(float(tree))


class Programs:
    """``trees`` as steps: equal subtrees once, each value dropped after its last use, so that a block of rows never holds the values of
    all nodes of a population. ``held``: the most values that are kept at a time."""

    def __init__(self, trees):
        self.steps: list = []                # (operator, or None where a program ends; operands; number of the result; numbers not used again)
        self.held, uses, known, stack = 0, {}, {}, list(trees)
        while stack:
            t = stack.pop()
            uses[t] = uses.get(t, 0) + 1
            if isinstance(t, tuple) and uses[t] == 1:
                stack += t[1:]

        def dropped(used):
            gone = []
            for t in used:
                uses[t] -= 1
                if isinstance(t, tuple) and not uses[t]:
                    gone.append(known.pop(t))
            return gone

        def place(t):
            if not isinstance(t, tuple):
                return t                     # a column or a constant
            if t not in known:
                args, at = [place(a) for a in t[1:]], len(self.steps)
                self.held = max(self.held, len(known) + 1)
                self.steps.append((t[0], args, at, dropped(t[1:])))
                known[t] = at
            return known[t]

        for t in trees:
            end = [place(t)]
            self.steps.append((None, end, None, dropped([t])))

    def run(self, inputs: dict, n: int):
        """The values of each program in turn, sanitised as E11: float32, not finite → 0, clipped to ±1e9."""
        kept: dict = {}

        def value(a):
            return kept[a] if isinstance(a, int) else inputs[a] if isinstance(a, str) else np.full(n, a)
        for op, args, at, gone in self.steps:
            with np.errstate(all="ignore"):
                z = value(args[0]).astype(np.float32).astype(np.float64) if op is None else _NUMPY[op](*[value(a) for a in args])
            for g in gone:
                del kept[g]
            if op is None:
                yield np.clip(np.where(np.isfinite(z), z, 0.0), -1e9, 1e9)
            else:
                kept[at] = z


def evaluate(trees, inputs: dict, n: int) -> np.ndarray:
    """(programs, rows), sanitised."""
    return np.array(list(Programs(trees).run(inputs, n)), np.float64).reshape(len(trees), n)


def _merge(a, b):
    """Two (n, mean x, mean y, Sxx, Sxy, Syy) of all programs; S are sums of centred products."""
    n, dx, dy = a[0] + b[0], b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / n
    return n, a[1] + dx * (b[0] / n), a[2] + dy * (b[0] / n), a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dx * dy, a[5] + b[5] + w * dy * dy


def correlations(df: DataFrame, cols, y: str, trees) -> np.ndarray:
    """|Pearson correlation| of every program with ``y`` in one pass; 0 for a constant. NULL rows must be filled before."""
    cols, trees = list(cols), list(trees)

    def emit(held):
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.float64()), pa.array([np.concatenate([np.broadcast_to(h, len(trees)) for h in held[1:]]).tobytes()])],
                                         names=["n", "sums"])

    def measure(batches):
        programs = Programs(trees)
        block = min(BLOCK, max(64, HELD_BYTES // 8 // max(1, programs.held)))
        held = None
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]
            for at in range(0, b.num_rows, block):
                part = [c[at:at + block] for c in x]
                t = part[-1]
                my = t.mean()
                d = t - my
                mx, xx, xy = np.empty((3, len(trees)))
                for i, z in enumerate(programs.run(dict(zip(cols, part, strict=False)), len(t))):
                    mx[i] = z.mean()
                    c = z - mx[i]
                    xx[i], xy[i] = c @ c, c @ d
                one = (float(len(t)), mx, my, xx, xy, d @ d)
                held = one if held is None else _merge(held, one)
        if held is not None:
            yield from emit(held)

    def read(n, sums):
        return (n, *np.frombuffer(bytes(sums)).reshape(5, len(trees)))

    def merge(batches):
        held = None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held = read(*row) if held is None else _merge(held, read(*row))
        if held is not None:
            yield from emit(held)

    schema = "n double, sums binary"
    parts = df.select(*[F.col(c).cast("double") for c in cols], F.col(y).cast("double").alias("_y")).mapInArrow(measure, schema)
    n = df.rdd.getNumPartitions()
    if n > FAN_IN:
        parts = parts.repartition(math.isqrt(n)).mapInArrow(merge, schema)
    held = None
    for row in parts.collect():          # not toLocalIterator, which runs one task at a time
        held = read(*row) if held is None else _merge(held, read(*row))
    if held is None:
        return np.zeros(len(trees))
    with np.errstate(all="ignore"):
        r = np.abs(held[4] / np.sqrt(held[3] * held[5]))
    return np.where(np.isfinite(r), np.minimum(r, 1.0), 0.0)


class Breeder:
    """Random trees and the four ways to vary them. Children of more than ``max_nodes`` nodes are not taken."""

    def __init__(self, cols, rnd: random.Random, depth=(2, 6), constants=(-1.0, 1.0), max_nodes: int = 64, p_replace: float = 0.05):
        self.cols, self.rnd, self.depth, self.constants, self.max_nodes, self.p_replace = list(cols), rnd, depth, constants, max_nodes, p_replace

    def leaf(self):
        i = self.rnd.randrange(len(self.cols) + 1)
        return self.cols[i] if i < len(self.cols) else self.rnd.uniform(*self.constants)

    def tree(self, depth: int | None = None, full: bool | None = None):
        """Half of the trees are full to their depth, half end where a leaf is drawn."""
        depth = self.rnd.randint(*self.depth) if depth is None else depth
        full = self.rnd.random() < 0.5 if full is None else full
        if depth <= 0 or (not full and self.rnd.random() < (len(self.cols) + 1) / (len(self.cols) + 1 + len(PSYM))):
            return self.leaf()
        op = self.rnd.choice(list(PSYM))
        return (op, *[self.tree(depth - 1, full) for _ in range(PSYM[op][0])])

    def first(self):
        """A tree of at least one operator within the size limit."""
        while True:
            t = self.tree()
            if isinstance(t, tuple) and size(t) <= self.max_nodes:
                return t

    def place(self, tree) -> tuple:
        """Path to a node: operators nine times in ten, where there are any."""
        inner, leaves = [], []

        def walk(t, path):
            (inner if isinstance(t, tuple) else leaves).append(path)
            for i, a in enumerate(t[1:] if isinstance(t, tuple) else ()):
                walk(a, (*path, i + 1))
        walk(tree, ())
        return self.rnd.choice(inner if inner and self.rnd.random() < 0.9 else leaves)

    def at(self, tree, path):
        for i in path:
            tree = tree[i]
        return tree

    def put(self, tree, path, new):
        if not path:
            return new
        i = path[0]
        return (*tree[:i], self.put(tree[i], path[1:], new), *tree[i + 1:])

    def crossover(self, a, b):
        return self.put(a, self.place(a), self.at(b, self.place(b)))

    def subtree(self, a):
        return self.crossover(a, self.first())

    def hoist(self, a):
        """A subtree of a subtree takes the latter's place: the child is never larger."""
        path = self.place(a)
        sub = self.at(a, path)
        return self.put(a, path, self.at(sub, self.place(sub)))

    def point(self, a):
        if not isinstance(a, tuple):
            return self.leaf() if self.rnd.random() < self.p_replace else a
        op = a[0]
        if self.rnd.random() < self.p_replace:
            op = self.rnd.choice([o for o in PSYM if PSYM[o][0] == PSYM[op][0]])
        return (op, *[self.point(x) for x in a[1:]])

    def child(self, pick, crossover: float, subtree: float, hoist: float, point: float):
        a, r = pick(), self.rnd.random()
        for p, vary in ((crossover, lambda: self.crossover(a, pick())), (subtree, lambda: self.subtree(a)),
                        (hoist, lambda: self.hoist(a)), (point, lambda: self.point(a))):
            if r < p:
                new = vary()
                return new if size(new) <= self.max_nodes else a
            r -= p
        return a


def least_correlated(corr: np.ndarray, keep: int) -> list[int]:
    """Indices (0 = the fittest) left after the less fit one of the most correlated pair left, again and again."""
    left = list(range(len(corr)))
    c = np.nan_to_num(np.abs(corr), nan=1.0)
    np.fill_diagonal(c, -1.0)
    while len(left) > keep:
        sub = c[np.ix_(left, left)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        del left[max(i, j)]
    return left


class EvolvedFeatures:
    """T12. NULL inputs take the median of the fitting rows; rows with a NULL target are left out. Generation g leaves out the
    rows whose ``key`` hash falls into one of ``1 / (1 - max_samples)`` parts, another part each time. ``history`` holds the
    best |correlation| of each generation. Without rows every program scores 0 and the result is arbitrary but defined."""

    def __init__(self, cols, key, n_keep: int = 3, population: int = 1000, generations: int = 15, hall_of_fame: int = 100, tournament: int = 20,
                 crossover: float = 0.9, subtree: float = 0.01, hoist: float = 0.01, point: float = 0.01, parsimony: float = 0.001,
                 max_samples: float = 0.9, max_nodes: int = 64, seed: int = 42, prefix: str = "symbolic_feat_"):
        self.cols, self.key, self.n_keep, self.population, self.generations = list(cols), [key] if isinstance(key, str) else list(key), n_keep, population, generations
        self.hall_of_fame, self.tournament, self.parsimony, self.max_samples = max(hall_of_fame, n_keep), tournament, parsimony, max_samples
        self.ways, self.max_nodes, self.seed, self.prefix = (crossover, subtree, hoist, point), max_nodes, seed, prefix
        self.medians: dict = {}
        self.best: list[tuple] = []
        self.history: list[float] = []

    def _inputs(self) -> dict:
        return {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c)), F.lit(0.0)) for c in self.cols}

    def fit(self, df: DataFrame, y: str):
        self.medians = exact_median_values(df, self.cols)
        parts = 0 if self.max_samples >= 1 else round(1 / (1 - self.max_samples))
        part = F.pmod(key_hash(*self.key), F.lit(parts)) if parts else F.lit(-1)
        data = df.where(F.col(y).isNotNull()).select(*[c.alias(f"_x{i}") for i, c in enumerate(self._inputs().values())], F.col(y).cast("double").alias("_t"),
                                                     part.alias("_part")).persist(StorageLevel.MEMORY_AND_DISK)
        names = {c: f"_x{i}" for i, c in enumerate(self.cols)}
        cols = list(names.values())
        rnd = random.Random(self.seed)
        breeder = Breeder(cols, rnd, max_nodes=self.max_nodes)
        pop = [breeder.first() for _ in range(self.population)]
        self.history = []
        for g in range(self.generations):
            trees = list(dict.fromkeys(pop))
            raw = dict(zip(trees, correlations(data.where(F.col("_part") != g % parts) if parts else data, cols, "_t", trees).tolist(), strict=True))
            self.history.append(max(raw.values()))
            if g < self.generations - 1:
                fit = {t: raw[t] - self.parsimony * size(t) for t in trees}

                def pick(pop=pop, fit=fit):
                    return max((rnd.choice(pop) for _ in range(self.tournament)), key=fit.__getitem__)
                pop = [breeder.child(pick, *self.ways) for _ in range(self.population)]
        fame = sorted(trees, key=lambda t: (-raw[t], size(t), formula(t)))[: self.hall_of_fame]

        def values(batches):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    z = evaluate(fame, dict(zip(cols, [c.to_numpy(zero_copy_only=False) for c in part.columns], strict=True)), part.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(r) for r in z], names=[f"f{i}" for i in range(len(fame))])

        names_of = [f"f{i}" for i in range(len(fame))]
        m = co_moments(data.select(*cols).mapInArrow(values, ", ".join(f"{c} double" for c in names_of)), names_of).get("")
        if m is not None:
            sd = np.sqrt(np.diag(m.m2))
            with np.errstate(all="ignore"):
                fame = [fame[i] for i in least_correlated(m.m2 / np.outer(sd, sd), self.n_keep)]
        back = {v: k for k, v in names.items()}

        def named(t):
            return (t[0], *[named(a) for a in t[1:]]) if isinstance(t, tuple) else back.get(t, t) if isinstance(t, str) else t
        self.best = [(formula(named(t)), raw[t], named(t)) for t in fame[: self.n_keep]]
        data.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        inputs = self._inputs()
        return df.withColumns({f"{self.prefix}{i + 1}": sanitize(as_column(t, inputs)) for i, (_, _, t) in enumerate(self.best)})
