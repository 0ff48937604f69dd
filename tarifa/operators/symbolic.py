"""Symbolic feature construction (T12), re-aimed for Spark.

Candidate formulas are small expression trees over the input columns built from the
protected operators (E17). The fitting rows are kept after one reading; each generation scores its new
candidates over them in one pass (``evolution.correlations``: blocks of rows as NumPy vectors, equal subtrees once; with an
all-NULL input, which only Columns tell from NaN, a few Columns in each aggregation); the fittest
half is kept and varied (subtree replacement, wrapping in a unary operator, or joining two
parents with a binary operator). The best ``n_keep`` distinct formulas become plain
columns, sanitised like the reference (float32, non-finite → 0, clipped to ±1e9).
"""

from __future__ import annotations

import random

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PSYM, psym, sanitize
from .evolution import correlations

UNARY = [k for k, (a, _) in PSYM.items() if a == 1]
BINARY = [k for k, (a, _) in PSYM.items() if a == 2]
TOGETHER = 5           # candidates of one aggregation: the code generated for many more is too long for the JVM to compile


def render(tree) -> str:
    if isinstance(tree, str):
        return tree
    op, *args = tree
    return f"{op}({', '.join(render(a) for a in args)})"


class SymbolicFeatures:
    """Inputs are median-imputed (medians of the fitting rows); the search runs on at most
    ``sample`` rows (a stable hash sample) and scores |corr| − parsimony × size."""

    def __init__(self, cols, n_keep: int = 3, generations: int = 5, population: int = 40, seed: int = 42,
                 max_depth: int = 3, prefix: str = "symbolic_feat_", parsimony: float = 0.001,
                 sample: int | None = None, key=None):
        self.cols = list(cols)
        self.n_keep = n_keep
        self.generations = generations
        self.population = population
        self.seed = seed
        self.max_depth = max_depth
        self.prefix = prefix
        self.parsimony = parsimony
        self.sample = sample
        self.key = key
        self.medians: dict = {}
        self.best: list[tuple] = []

    def _size(self, t):
        return 1 if isinstance(t, str) else 1 + sum(self._size(a) for a in t[1:])

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c)))
                               for c in self.cols})

    def _random_tree(self, rnd, depth):
        if depth <= 0 or rnd.random() < 0.3:
            return rnd.choice(self.cols)
        if rnd.random() < 0.4:
            return (rnd.choice(UNARY), self._random_tree(rnd, depth - 1))
        return (rnd.choice(BINARY), self._random_tree(rnd, depth - 1), self._random_tree(rnd, depth - 1))

    def _depth(self, t):
        return 0 if isinstance(t, str) else 1 + max(self._depth(a) for a in t[1:])

    def _vary(self, rnd, a, b):
        r = rnd.random()
        if r < 0.4:
            child = (rnd.choice(BINARY), a, b)
        elif r < 0.7:
            child = (rnd.choice(UNARY), a)
        else:
            child = self._random_tree(rnd, self.max_depth)
        return child if self._depth(child) <= self.max_depth else self._random_tree(rnd, 2)

    def _named(self, t, names):
        return names[t] if isinstance(t, str) else (t[0], *[self._named(a, names) for a in t[1:]])

    def _values(self, df: DataFrame, y: str, trees) -> DataFrame:
        """``_y`` and ``_v0``, ``_v1``, .. of ``trees``. Every distinct subtree is a column of its own, a projection per depth: the
        guards name their operand several times, which would otherwise be computed anew at each level above it."""
        names = {c: f"_n{i}" for i, c in enumerate(self.cols)}
        levels: dict[int, list] = {}

        def place(t):
            if t not in names:
                for a in t[1:]:
                    place(a)
                names[t] = f"_n{len(names)}"
                levels.setdefault(self._depth(t), []).append(t)
        for t in trees:
            place(t)
        d = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(names[c]) for c in self.cols])
        for k in sorted(levels):
            d = d.withColumns({names[t]: psym(t[0], *[F.col(names[a]) for a in t[1:]]) for t in levels[k]})
        d = d.select("_y", *[F.col(names[t]).cast("float").cast("double").alias(f"_f{i}") for i, t in enumerate(trees)])
        return d.select("_y", *[sanitize(F.col(f"_f{i}")).alias(f"_v{i}") for i in range(len(trees))])

    def _score(self, df: DataFrame, y: str, trees) -> list[float]:
        if all(self.medians.get(c) is not None for c in self.cols):
            inputs = [F.col(c).alias(f"_x{i}") for i, c in enumerate(self.cols)]
            rows = df.where(F.col(y).isNotNull()).select(*inputs, F.col(y).alias("_t"))
            names = {c: f"_x{i}" for i, c in enumerate(self.cols)}
            return correlations(rows, list(names.values()), "_t", [self._named(t, names) for t in trees]).tolist()
        # correlation written out with try_divide: a constant candidate scores NULL → 0
        def corr(x):
            return F.try_divide(F.covar_pop(x, "_y"), F.stddev_pop(x) * F.stddev_pop("_y"))
        out: list[float] = []
        for at in range(0, len(trees), TOGETHER):
            part = trees[at:at + TOGETHER]
            row = self._values(df, y, part).agg(*[corr(f"_v{i}").alias(f"c{i}") for i in range(len(part))]).first()
            out += [abs(c) if c is not None else 0.0 for c in row]
        return out

    def fit(self, df: DataFrame, y: str):
        from .quantiles import exact_median_values
        from .relational import sample_n
        keys = [] if self.sample is None or self.key is None else [self.key] if isinstance(self.key, str) else list(self.key)
        kept = df.select(*dict.fromkeys([*keys, *self.cols, y])).persist(StorageLevel.MEMORY_AND_DISK)     # read again by the medians and every generation
        self.medians = exact_median_values(kept, self.cols)
        rows = sample_n(kept, self.sample, keys, seed=self.seed) if keys else kept
        cores, few = df.sparkSession.sparkContext.defaultParallelism, None
        if rows.rdd.getNumPartitions() < cores:          # few rows come in few parts, though a generation is much work a row
            rows = few = rows.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
        df = self._filled(rows)
        rnd = random.Random(self.seed)
        pop = [self._random_tree(rnd, 2) for _ in range(self.population)]
        scored: dict[str, tuple] = {}
        for _ in range(self.generations):
            fresh = [t for t in pop if render(t) not in scored]
            for t, s in zip(fresh, self._score(df, y, fresh) if fresh else []):
                scored[render(t)] = (s - self.parsimony * self._size(t), t)
            ranked = sorted(scored.values(), key=lambda st: (-st[0], render(st[1])))
            parents = [t for _, t in ranked[: max(2, self.population // 2)]]
            pop = parents + [self._vary(rnd, rnd.choice(parents), rnd.choice(parents))
                             for _ in range(self.population - len(parents))]
        ranked = sorted(scored.values(), key=lambda st: (-st[0], render(st[1])))
        kept.unpersist()
        if few is not None:
            few.unpersist()
        self.best = [(render(t), s, t) for s, t in ranked[: self.n_keep]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c))) for c in self.cols}

        def col_of(t):
            if isinstance(t, str):
                return filled[t]
            op, *args = t
            return psym(op, *[col_of(a) for a in args])
        return df.withColumns({f"{self.prefix}{i + 1}": sanitize(col_of(t)) for i, (_, _, t) in enumerate(self.best)})
