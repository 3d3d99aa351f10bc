"""Hyperparameter search: a factorial grid in one parallel job, then Bayesian acquisitions.

The surrogate is a Gaussian process with a Matern-5/2 kernel and a length scale for each dimension; points are proposed
by a hedge over expected improvement, probability of improvement and lower confidence bound (published methods).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from . import model as m


def axis_points(cfg: Config, n_axes: int) -> int:
    """Points of each axis: at most n_grid, and so few that the grid fits the evaluations."""
    return cfg.n_grid if not n_axes else max(1, min(cfg.n_grid, int(cfg.n_func_evals ** (1.0 / n_axes))))


def grid(cfg: Config) -> tuple[list[str], list[list[float]]]:
    """(axes, points), the last axis running fastest. Ridge candidates aren't an axis: all are tried at each point.
    With no axis there is one point, so that they are."""
    axes = [x for x in cfg.searched() if x != "tikh"]
    k = axis_points(cfg, len(axes))
    return axes, [list(map(float, p)) for p in product(*[np.linspace(*cfg.range_of(a), k) for a in axes])]


def grid_frame(spark: SparkSession, cfg: Config) -> DataFrame:
    axes, points = grid(cfg)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "cand long" + "".join(f", {a} double" for a in axes))


def ridges(cfg: Config) -> tuple[float, ...]:
    return tuple(cfg.tikh_range) if "tikh" in cfg.optimize else (cfg.tikh,)


def apply(model: m.Model, axes: list[str], point: list[float]) -> m.Model:
    """The model with a point's settings; sigma_in's axis is its log10, parameter axes change shift and norm."""
    changes, norm, shift = {}, model.norm.copy(), model.shift.copy()
    first = model.cfg.n_dim_in - model.cfg.n_param
    for a, x in zip(axes, point, strict=True):
        if a.startswith("param_shift_"):
            shift[first + int(a.rsplit("_", 1)[1])] = x
        elif a.startswith("param_norm_"):
            norm[first + int(a.rsplit("_", 1)[1])] = x
        else:
            changes[a] = 10**x if a == "sigma_in" else x
    return m.Model(model.cfg.with_(**changes), model.w_in, model.w, model.w_out, norm, shift, model.summary, model.trace)


def evaluate(model: m.Model, train: DataFrame, strategy: str | Callable, axes: list[str], points: list[list[float]]) -> list[tuple[float, float, int]]:
    """(loss, best ridge, folds) of each point. Points that differ in the reservoir's settings only share their jobs;
    other input scaling needs jobs of its own."""
    how = m.STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    tried = [apply(model, axes, p) for p in points]
    by_scale: dict[tuple, list[int]] = {}
    for i, x in enumerate(tried):
        by_scale.setdefault((*x.norm, *x.shift), []).append(i)
    out: list = [None] * len(points)
    for group in by_scale.values():
        cfgs = [tried[i].cfg for i in group]
        cands = m.Candidates(*[np.array([getattr(c, k) for c in cfgs], float) for k in ("rho", "sigma_in", "leak_rate")], ridges(model.cfg))
        for r in m.best_tikh(how(tried[group[0]], train, cands)).collect():
            out[group[r.cand]] = (float(r.loss), cands.tikh[r.tikh_idx], int(r.n_folds))
    if any(x is None for x in out):
        raise ValueError("no segment is long enough for one fold of n_wash + n_val steps; reduce t_val or n_wash")
    return out


# ---- surrogate


def matern52(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum((((a[:, None] - b[None]) / scale) ** 2).sum(-1), 0))
    return (1 + math.sqrt(5) * d + 5 / 3 * d**2) * np.exp(-math.sqrt(5) * d)


class Process:
    """Gaussian process on the unit cube; scales by coordinate search on the marginal likelihood."""

    SCALES = np.geomspace(1e-2, 10, 13)

    def __init__(self, x: np.ndarray, y: np.ndarray, jitter: float = 1e-8):
        self.x, self.mean, self.std = x, y.mean(), y.std() or 1.0
        self.y, self.jitter = (y - self.mean) / self.std, jitter
        scale = np.full(x.shape[1], 0.3)
        for _ in range(2):
            for d in range(x.shape[1]):
                trials = [np.where(np.arange(len(scale)) == d, s, scale) for s in self.SCALES]
                scale = max(trials, key=self._likelihood)
        self.scale = scale
        self.chol = self._factor(scale)
        self.weights = np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, self.y))

    def _factor(self, scale: np.ndarray) -> np.ndarray:
        return np.linalg.cholesky(matern52(self.x, self.x, scale) + self.jitter * np.eye(len(self.x)))

    def _likelihood(self, scale: np.ndarray) -> float:
        try:
            c = self._factor(scale)
        except np.linalg.LinAlgError:
            return -np.inf
        z = np.linalg.solve(c, self.y)
        return float(-0.5 * z @ z - np.log(np.diag(c)).sum())

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = matern52(x, self.x, self.scale)
        v = np.linalg.solve(self.chol, k.T)
        return k @ self.weights, np.sqrt(np.maximum(1 - (v**2).sum(0), 1e-12))


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def propose(x: np.ndarray, y: np.ndarray, gains: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(next point, gains of the three rules). The rule is drawn by its gains so far."""
    gp = Process(x, y)
    trial = rng.random((2000, x.shape[1]))
    trial = np.concatenate([trial, np.clip(x[y.argmin()] + 0.05 * rng.normal(size=(200, x.shape[1])), 0, 1)])
    mu, sd = gp.predict(trial)
    z = (gp.y.min() - 0.01 - mu) / sd
    improvement = sd * (z * _normal_cdf(z) + np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi))
    picks = [int(improvement.argmax()), int(_normal_cdf(z).argmax()), int((mu - 1.96 * sd).argmin())]
    chance = np.exp(gains - gains.max())
    chosen = picks[rng.choice(3, p=chance / chance.sum())]
    return trial[chosen], gains - np.array([mu[p] for p in picks])


def explore(cfg: Config, score: Callable) -> tuple[list[str], list[list[float]], list[tuple], int]:
    """(axes, points, what ``score(axes, points)`` gave for each: (loss, ridge, folds), points of the grid): the grid
    and random points at once, then one acquisition after the other."""
    axes, points = grid(cfg)
    points = points[: cfg.n_func_evals] if axes else [[]]
    rng = np.random.default_rng([10, cfg.seed])
    ranges = np.array([cfg.range_of(a) for a in axes], float).reshape(-1, 2)
    unit = lambda p: (np.asarray(p) - ranges[:, 0]) / np.maximum(ranges[:, 1] - ranges[:, 0], 1e-300)
    n_grid = len(points)
    more = min(cfg.n_initial_rand, cfg.n_func_evals - n_grid) if axes else 0
    points += [(ranges[:, 0] + rng.random(len(axes)) * (ranges[:, 1] - ranges[:, 0])).tolist() for _ in range(more)]
    found = list(score(axes, points))
    gains = np.zeros(3)
    while axes and len(points) < cfg.n_func_evals:
        x, gains = propose(np.array([unit(p) for p in points]), np.array([f[0] for f in found]), gains, rng)
        points.append((ranges[:, 0] + x * (ranges[:, 1] - ranges[:, 0])).tolist())
        found += score(axes, points[-1:])
    return axes, points, found, n_grid


def optimise(model: m.Model, train: DataFrame, strategy: str | Callable = "recycle") -> tuple[m.Model, list[dict]]:
    """The model with the best settings found, the first on ties, and the trace of all evaluations."""
    train = train.cache()
    try:
        axes, points, found, n_grid = explore(model.cfg, lambda axes, points: evaluate(model, train, strategy, axes, points))
    finally:
        train.unpersist()
    losses = np.array([f[0] for f in found])
    best = int(np.nanargmin(losses))
    out = apply(model, axes, points[best])
    out = m.Model(out.cfg.with_(tikh=found[best][1]), out.w_in, out.w, out.w_out, out.norm, out.shift, out.summary, out.trace)
    trace = [{"eval": i, **dict(zip(axes, p, strict=True)), "tikh": f[1], "loss": f[0], "n_folds": f[2], "is_grid": i < n_grid} for i, (p, f) in enumerate(zip(points, found, strict=True))]
    return out, trace
