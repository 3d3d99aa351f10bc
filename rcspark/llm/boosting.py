"""Small gradient-boosted trees: grown at the driver from sums over all rows, applied as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf if ``feature`` is None: adds ``value``. Else rows with feature > cutoff go right."""

    value: float = 0.0
    feature: str | None = None
    cutoff: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Node, ...]

    def score(self, get: Callable[[str], Column]) -> Column:
        """The log-odds; ``get`` gives a feature's column."""

        def of(node: Node) -> Column:
            if node.feature is None:
                return F.lit(node.value)
            return F.when(get(node.feature) > F.lit(node.cutoff), of(node.right)).otherwise(of(node.left))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        def of(node: Node) -> np.ndarray:
            if node.feature is None:
                return np.full(len(x), node.value)
            return np.where(x[:, names.index(node.feature)] > node.cutoff, of(node.right), of(node.left))

        return self.base + sum((of(t) for t in self.trees), np.zeros(len(x)))


#: Gradients are summed in whole parts of this, so that sums don't depend on their order.
UNIT = 1 << 24


def place(splits: dict[int, tuple[str, float]], depth: int, get, choose):
    """The node at ``depth`` of the tree so far that a row falls to, numbered as in a heap; nodes without a split keep
    their rows, under the number of their leftmost child. ``get`` gives a feature, ``choose`` one of two by a condition."""

    def of(node: int, left: int):
        if not left:
            return node
        low = of(2 * node + 1, left - 1)
        return low if node not in splits else choose(get(splits[node][0]) > splits[node][1], of(2 * node + 2, left - 1), low)

    return of(0, depth)


def quantiles(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """The distinct lower quantiles of ``values``, ascending, of which there are ``weight`` each."""
    ends = np.cumsum(weight)
    at = np.floor(np.linspace(0, 1, bins + 1)[:-1] * (ends[-1] - 1))
    return np.unique(values[np.searchsorted(ends, at, "right")])


def boost(sums: Callable[[Boosted, dict, int], dict], cuts: dict[str, np.ndarray], mean: float, rounds: int = 30, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Boosted:
    """Trees grown level by level from sums over all rows, wherever these are. ``sums`` of the model so far, the tree's
    splits so far and a depth gives, by node at that depth and feature, [gradients, Hessians, rows] by bin; a row is in
    bin k of a feature if k of its cuts are below its value. ``mean``: the share of positive rows."""
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), ())
    for _ in range(rounds):
        splits: dict[int, tuple[str, float]] = {}
        totals: dict[int, np.ndarray] = {}
        for level in range(depth + 1):
            found = sums(model, splits, level)
            for node in range((1 << level) - 1, (1 << (level + 1)) - 1):
                parent = (node - 1) // 2
                if node not in found or (node and parent not in splits):
                    continue
                totals[node] = g, h, n = next(iter(found[node].values())).sum(1)
                best = (1e-6, None, None)
                for f in cuts if level < depth and n >= 20 else ():
                    left = np.cumsum(found[node][f], 1)[:, : len(cuts[f])]
                    gain = left[0] ** 2 / (left[1] + l2) + (g - left[0]) ** 2 / (h - left[1] + l2) - g**2 / (h + l2)
                    gain = np.where((left[2] >= 5) & (n - left[2] >= 5), gain, 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, float(cuts[f][gain.argmax()]))
                if best[1] is not None:
                    splits[node] = best[1:]
            if not any(node in splits for node in range((1 << level) - 1, (1 << (level + 1)) - 1)):
                break
        if not splits:
            break

        def made(node: int) -> Node:
            if node not in splits:
                g, h, _ = totals[node]
                return Node(value=float(round(-rate * g / (h + l2), 10)))
            return Node(feature=splits[node][0], cutoff=splits[node][1], left=made(2 * node + 1), right=made(2 * node + 2))

        model = Boosted(model.base, (*model.trees, made(0)))
    return model


def local_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: dict[str, np.ndarray]):
    """``sums`` of rows at hand; the columns of x are in the order of ``cuts``."""
    names = list(cuts)
    bins = {f: np.searchsorted(cuts[f], x[:, k], "left") for k, f in enumerate(names)}

    def sums(model: Boosted, splits: dict, level: int) -> dict:
        p = np.round(UNIT / (1 + np.exp(-model.predict(x, names))))
        parts = [weight * (p - UNIT * y), weight * np.round(p * (UNIT - p) / UNIT), weight * UNIT]
        node = place(splits, level, lambda f: x[:, names.index(f)], np.where) + np.zeros(len(x), np.int64)
        out: dict[int, dict] = {}
        for own in np.unique(node):
            rows = node == own
            out[int(own)] = {f: np.array([np.bincount(bins[f][rows], v[rows], len(cuts[f]) + 1) for v in parts]) / UNIT for f in names}
        return out

    return sums


def spread_sums(rows: DataFrame, y: str, weight: str, cuts: dict[str, np.ndarray]):
    """``sums`` of a table; only sums by node, feature and bin reach the driver."""
    names = list(cuts)

    def bin_of(f: str) -> Column:
        return sum((F.when(F.col(f) > F.lit(float(c)), 1).otherwise(0) for c in cuts[f]), F.lit(0))

    def sums(model: Boosted, splits: dict, level: int) -> dict:
        node = place(splits, level, F.col, lambda c, a, b: F.when(c, a).otherwise(b))
        p = F.rint(F.lit(float(UNIT)) / (1 + F.exp(-model.score(F.col))))
        told = rows.select((F.lit(node) if isinstance(node, int) else node).alias("node"), F.col(weight).alias("w"), F.col(y).alias("y"), p.alias("p"), F.posexplode(F.array(*map(bin_of, names))).alias("f", "bin"))
        hess = F.rint(F.col("p") * (F.lit(UNIT) - F.col("p")) / F.lit(UNIT))
        found = told.groupBy("node", "f", "bin").agg(
            F.sum(F.col("w") * (F.col("p") - F.lit(UNIT) * F.col("y")).cast("long")).alias("g"), F.sum(F.col("w") * hess.cast("long")).alias("h"), F.sum("w").alias("n")
        )
        out: dict[int, dict] = {}
        for r in found.collect():
            own = out.setdefault(r.node, {f: np.zeros((3, len(cuts[f]) + 1)) for f in names})
            own[names[r.f]][:, r.bin] = r.g / UNIT, r.h / UNIT, r.n
        return out

    return sums


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 8) -> Boosted:
    """Logistic loss, second-order leaves, cutoffs at quantiles of each feature. Deterministic."""
    one = np.ones(len(y), np.int64)
    cuts = {f: quantiles(np.sort(x[:, k]), one, bins) for k, f in enumerate(names)}
    return boost(local_sums(x, y, one, cuts), cuts, float(y.mean()), rounds, depth, rate)
