"""Sequential hyper-parameter search by density ratio.

After ``n_start`` random trials the trials so far are parted into good and bad by score. For each parameter a Parzen
estimate of either part (Gaussian kernels cut to the range, plus one flat kernel) gives l(x) and g(x); candidates are
drawn from l, and those with the largest sum of log l(x) - log g(x) are the next trials. Proposals come in batches, so
the boosters of a batch are grown together (``forest.grow``); with ``batch=1`` every trial sees all before it.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest as FO
from .relational import regression_metrics


@dataclass(frozen=True)
class Range:
    """Bounds of a parameter, both included; ``step``: low, low + step, ..; ``log``: even on a logarithmic scale."""
    low: float
    high: float
    step: int | None = None
    log: bool = False

    def value(self, u: float):
        """The value at place ``u`` of [0, 1]."""
        if self.step is not None:
            n = int((self.high - self.low) // self.step) + 1
            return self.low + self.step * min(n - 1, int(u * n))
        if self.log:
            return min(self.high, max(self.low, math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))))
        return self.low + u * (self.high - self.low)

    def place(self, value) -> float:
        if self.step is not None:
            n = int((self.high - self.low) // self.step) + 1
            return ((value - self.low) / self.step + 0.5) / n
        if self.log:
            return (math.log(value) - math.log(self.low)) / ((math.log(self.high) - math.log(self.low)) or 1.0)
        return (value - self.low) / ((self.high - self.low) or 1.0)


class Parzen:
    """Density on [0, 1]: one kernel a point, as wide as the larger gap to its neighbours, and a flat one."""

    def __init__(self, points):
        p = sorted(points)
        around = [0.0, *p, 1.0]
        floor = 1.0 / min(100.0, len(p) + 2.0)
        self.kernels = [(x, min(1.0, max(around[i + 1] - around[i], around[i + 2] - around[i + 1], floor))) for i, x in enumerate(p)]

    @staticmethod
    def _mass(x: float, w: float) -> float:
        return 0.5 * (math.erf((1 - x) / (w * math.sqrt(2))) + math.erf(x / (w * math.sqrt(2))))

    def density(self, u: float) -> float:
        total = 1.0
        for x, w in self.kernels:
            total += math.exp(-0.5 * ((u - x) / w) ** 2) / (w * math.sqrt(2 * math.pi) * self._mass(x, w))
        return total / (len(self.kernels) + 1)

    def draw(self, rnd: random.Random) -> float:
        i = rnd.randrange(len(self.kernels) + 1)
        if i == len(self.kernels):
            return rnd.random()
        x, w = self.kernels[i]
        while True:
            u = rnd.gauss(x, w)
            if 0.0 <= u <= 1.0:
                return u


def propose(trials: list, space: dict, n: int, rnd: random.Random, candidates: int = 24, good: float = 0.25) -> list[dict]:
    """``n`` new configurations after ``trials`` [(config, score)], larger scores being better; NaN or None is worst."""
    ranked = sorted(trials, key=lambda t: -math.inf if t[1] is None or math.isnan(t[1]) else t[1], reverse=True)
    cut = max(1, math.ceil(good * len(ranked)))
    best, rest = ({k: Parzen([r.place(c[k]) for c, _ in part]) for k, r in space.items()} for part in (ranked[:cut], ranked[cut:]))
    drawn = []
    for _ in range(candidates * n):
        u = {k: best[k].draw(rnd) for k in space}
        drawn.append((sum(math.log(best[k].density(u[k])) - math.log(rest[k].density(u[k])) for k in space), u))
    drawn.sort(key=lambda t: -t[0])
    tried = [c for c, _ in trials]
    out: list[dict] = []
    for _, u in drawn:
        c = {k: r.value(u[k]) for k, r in space.items()}
        if c not in tried and c not in out:
            out.append(c)
        if len(out) == n:
            return out
    return out + [{k: r.value(rnd.random()) for k, r in space.items()} for _ in range(n - len(out))]


def density_ratio_search(evaluate, space: dict, n_trials: int = 15, n_start: int = 5, batch: int = 1, candidates: int = 24, good: float = 0.25,
                         seed: int = 42) -> list[tuple]:
    """[(config, score)] in order of trial. ``evaluate``: list of configurations -> list of scores."""
    rnd = random.Random(seed)
    trials: list[tuple] = []
    while len(trials) < n_trials:
        n = min(batch, n_trials - len(trials))
        if len(trials) < n_start:
            n = min(max(n, n_start), n_trials)
            configs = [{k: r.value(rnd.random()) for k, r in space.items()} for _ in range(n)]
        else:
            configs = propose(trials, space, n, rnd, candidates, good)
        trials += list(zip(configs, evaluate(configs), strict=True))
    return trials


# Fixed values that must equal the reference's results: bounds of the sequential search of a boosted Tweedie expert.
TWEEDIE_SPACE = {"n_estimators": Range(200, 800, 100), "learning_rate": Range(0.01, 0.15, log=True), "max_depth": Range(4, 10, 1),
                 "tweedie_variance_power": Range(1.1, 1.9)}


def boosted_search(df: DataFrame, valid, features, y: str, n_trials: int = 15, n_start: int = 5, batch: int = 5, patience: int = 20, space: dict | None = None,
                   round_cap: int | None = None, seed: int = 42) -> DataFrame:
    """Boosted Tweedie experts fitted on the rows of ``df`` outside ``valid``, ended after ``patience`` rounds without a
    smaller validation loss, scored by R² on the rows of ``valid``. One row per trial in order: trial, score r2, trees and
    the parameters. NULL targets are left out. ``round_cap`` bounds the rounds of a trial."""
    space = space or TWEEDIE_SPACE
    d = df.where(F.col(y).isNotNull()).withColumn("_valid", valid).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[int] = []

    def evaluate(configs):
        families = [FO.Family("tweedie", power=c["tweedie_variance_power"], step=c["learning_rate"], depth=int(c["max_depth"]),
                              rounds=int(min(c["n_estimators"], round_cap or c["n_estimators"]))) for c in configs]
        m = FO.grow(d, features, y, [FO.Slot(f"t{i}", f) for i, f in enumerate(families)], valid=F.col("_valid"), patience=patience)
        preds = [f"_p{i}" for i in range(len(configs))]
        got = regression_metrics(m.transform(d.where("_valid"), {p: (f"t{i}", None) for i, p in enumerate(preds)}), y, preds).collect()
        r2 = {r["model"]: r["r2"] for r in got}
        trees.extend(int(m.slots[f"t{i}"].rounds[0]) for i in range(len(configs)))
        return [r2.get(p) for p in preds]

    trials = density_ratio_search(evaluate, space, n_trials, n_start, batch, seed=seed)
    d.unpersist()
    rows = [(i, s, n, *[float(c[k]) for k in space]) for i, ((c, s), n) in enumerate(zip(trials, trees, strict=True))]
    return df.sparkSession.createDataFrame(rows, "trial int, r2 double, trees int, " + ", ".join(f"{k} double" for k in space))
