"""Isolation forests: rows that random splits set apart early are unlike the rest.

Trees see bounded subsamples, so a forest is grown from no more than trees x sample rows whatever the table's size, each
tree in a task of its own; scoring passes over the table once, in batches of columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counters import values_at

# Size of a forest and the bounds of the share of rows taken for anomalies.
TREES, SAMPLE = 400, 256
LEAST_SHARE, MOST_SHARE = 0.01, 0.20
_NODE = "tree int, node int, feature int, threshold double, left int, right int, length double"


def usual_length(n: float) -> float:
    """The mean path of a search without success among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grown(x: np.ndarray, random: np.random.Generator) -> list[tuple]:
    """Nodes ``(feature, threshold, left, right, length)`` of one tree; leaves have feature -1 and their path length."""
    most = math.ceil(math.log2(max(len(x), 2)))
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        free = np.flatnonzero(low < high)
        if depth >= most or len(rows) < 2 or not len(free):
            nodes[at] = (-1, 0.0, at, at, depth + usual_length(len(rows)))
            return at
        f = int(random.choice(free))
        cut = low[f] + random.random() * (high[f] - low[f])
        # never so that a side is empty, however close the two ends are
        cut = cut if low[f] < cut else high[f]
        side = x[rows, f] < cut
        left, right = grow(rows[side], depth + 1), grow(rows[~side], depth + 1)
        nodes[at] = (f, float(cut), left, right, 0.0)
        return at

    grow(np.arange(len(x)), 0)
    return nodes


@dataclass
class IsolationForest:
    """``score``: 2 to the minus mean path over usual path, 0 to 1; the greater, the less like the rest. Values that are no finite numbers count as 0."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        x = np.where(np.isfinite(x), x, 0.0)
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                here, rows = at[inner], row[inner]
                at[inner] = np.where(x[rows, self.feature[here]] < self.threshold[here], self.left[here], self.right[here])
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.usual) if self.usual else np.full(len(x), 0.5)


def fit_isolation_forest(df: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> IsolationForest | None:
    """A forest of ``trees`` trees, each grown from its own ``sample`` rows of one uniform sample of the table; None of an empty one.

    Where the table has fewer than trees x sample rows, all are dealt out to as many trees as that gives
    full samples for, at least one. Nulls and values that are no finite numbers count as 0. The driver holds the
    nodes, fewer than 2 x trees x sample.
    """
    number = lambda c: F.coalesce(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")), F.lit(0.0)).alias(c)
    most = trees * sample
    chosen = df.select(*map(number, features), F.rand(seed).alias("_r")).orderBy("_r").limit(most).drop("_r")
    n = min(most, df.limit(most).count())
    if not n:
        return None
    used = max(1, min(trees, n // sample))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = _grown(rows[features].to_numpy(dtype=float), np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([(int(key[0]), k, *node) for k, node in enumerate(nodes)], columns=[f.split()[0] for f in _NODE.split(", ")])

    # what limit leaves is one partition, in which these numbers follow each other
    dealt = chosen.withColumn("_tree", F.pmod(F.monotonically_increasing_id(), F.lit(used)))
    found = dealt.groupBy("_tree").applyInPandas(grow, _NODE).toPandas().sort_values(["tree", "node"], ignore_index=True)
    roots = np.flatnonzero(found["node"] == 0)
    start = np.repeat(roots, np.diff(np.append(roots, len(found))))
    side = lambda c: found[c].to_numpy() + start
    return IsolationForest(roots, found["feature"].to_numpy(), found["threshold"].to_numpy(), side("left"), side("right"), found["length"].to_numpy(), usual_length(-(-n // used)))


def share_of(df: DataFrame, label: str) -> float:
    """The share of anomalies by ``label``, within the bounds that are used."""
    found = df.agg(F.avg(F.coalesce(F.col(label).cast("double"), F.lit(0.0)))).first()[0] or 0.0
    return min(max(found, LEAST_SHARE), MOST_SHARE)


def threshold_of(scores: DataFrame, column: str, share: float) -> float | None:
    """The score that the greatest ``share`` of scores reach: between two of them by their distance. Found by rounds, without a sort."""
    n = scores.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = (1 - share) * (n - 1)
    low = math.floor(at)
    found = values_at(scores, column, [low + 1, min(low + 2, n)])
    a, b = found[low + 1], found[min(low + 2, n)]
    return a + (b - a) * (at - low)


def is_anomalous(score: Column, threshold: float) -> Column:
    return F.coalesce((score >= threshold).cast("int"), F.lit(0))
