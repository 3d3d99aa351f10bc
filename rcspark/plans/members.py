"""Comparing validation strategies over an ensemble of small models on one short series.

A member (strategy, seed) is a whole experiment: a search by its strategy, a readout from all of train and validation,
and closed-loop tests. Its series is short by the experiment's design, so members are what is dealt out: each is a row
of a table and is trained in one task, and the series goes along (its length is a parameter, not the data's size). The
reports are ``ensemble``'s aggregates over the member table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..functions.metrics import LOG_PENALTY
from ..operators import folds, recurrence, ridge, weights
from ..sources import chaos
from . import search


@dataclass(frozen=True)
class Strategy:
    """How folds are laid: a name of ``folds.STRATEGIES``, at most so many, and their step if not the interval."""

    how: str
    n_folds: int
    step: int | None = None


@dataclass(frozen=True)
class Tests:
    """Closed-loop tests on the series' rest: where they start, wash-out, forecast, steps of the squared error, and the
    relative error that ends the horizon. Steps, but for the last."""

    starts: tuple[int, ...]
    n_wash: int
    n_steps: int
    n_error: int
    threshold: float = 0.2


def states(model: recurrence.Reservoir, u: np.ndarray) -> np.ndarray:
    one = np.zeros(len(u), np.int64)
    return recurrence.lock_step(one, model.inputs(u), one, np.zeros((1, model.n_units)), model.advance)


def log_error(y: np.ndarray, yhat: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """log10 of mean |y - yhat| / mean |norm| of each window, or the penalty."""
    with np.errstate(all="ignore"):
        e = np.log10(np.abs(y - yhat).mean((1, 2)) / np.abs(norm).mean())
    return np.where(np.isfinite(e), e, LOG_PENALTY)


def validate(model: recurrence.Reservoir, u: np.ndarray, y: np.ndarray, cfg: Config, strategy: Strategy, tikh: float) -> tuple[float, int]:
    """(mean log error, folds) of one setting, as the distributed strategies score a single series."""
    r, wash, v = states(model, u), cfg.n_wash, cfg.n_val
    rows = np.concatenate([r, np.full((len(r), 1), model.bias_out)], 1)[wash:]
    whole, z = np.concatenate([rows, y[wash:]], 1), y[wash:]
    if strategy.how == "recycle":
        span = len(u) - wash - v
        k = min(strategy.n_folds, span + 1)
        places = [f * (span // (k - 1) if k > 1 else 0) for f in range(k)]
        w_out = np.stack([ridge.solve(rows.T @ whole, tikh)] * k)
        first = np.zeros((k, model.n_units))
        for i in range(wash):
            first = model.advance(first, model.inputs(u[[p + i for p in places]]))
        truth = np.stack([y[p + wash : p + wash + v] for p in places])
    else:
        table = folds.single_series_table(strategy.how, len(z), v, strategy.n_folds, strategy.step)
        ranges = [folds.train_ranges(f) for f in table]
        borders = sorted({0, len(z)} | {x for rs in ranges for ab in rs for x in ab})
        sums = np.cumsum([np.zeros((rows.shape[1], whole.shape[1])), *[rows[a:b].T @ whole[a:b] for a, b in zip(borders, borders[1:])]], 0)
        at = {b: i for i, b in enumerate(borders)}
        w_out = np.stack([ridge.solve(sum(sums[at[b]] - sums[at[a]] for a, b in rs), tikh) for rs in ranges])
        first = np.stack([r[i0 + wash - 1] for _, _, _, i0, _ in table])
        truth = np.stack([z[i0:i1] for _, _, _, i0, i1 in table])
    pred = recurrence.closed_loop(model, w_out, first, v, range(u.shape[1]))
    return float(log_error(truth, pred, np.ptp(y, 0)).mean()), len(w_out)


def run_tests(model: recurrence.Reservoir, w_out: np.ndarray, data: np.ndarray, tests: Tests, span: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean squared error, horizon in steps) of each window, of errors relative to the dimensions' ranges; the horizon
    is where an error's length passes the threshold, relative to ``size``."""
    starts, r = np.array(tests.starts), np.zeros((len(tests.starts), model.n_units))
    for i in range(tests.n_wash):
        r = model.advance(r, model.inputs(data[starts + i]))
    pred = recurrence.closed_loop(model, w_out, r, tests.n_steps, range(data.shape[1]))
    truth = data[starts[:, None] + tests.n_wash + 1 + np.arange(tests.n_steps)]
    with np.errstate(all="ignore"):
        e = (pred - truth) / span
        over = ~(np.linalg.norm(e, axis=2) / size <= tests.threshold)
    horizon = np.where(over.any(1), over.argmax(1) + 1, tests.n_steps)
    return np.nan_to_num((e[:, : tests.n_error] ** 2).mean((1, 2)), nan=1e6, posinf=1e6), horizon


def train(data: np.ndarray, rest: np.ndarray, cfg: Config, strategy: Strategy, tests: Tests) -> dict:
    """One member."""
    y = data[1:]
    u = data[:-1] + cfg.noise * data[:-1].std(0) * weights.stream(cfg.seed, "noise").normal(size=data[:-1].shape)
    w_in, w = weights.input_matrix(cfg), weights.reservoir_matrix(cfg)
    norm = np.where(np.ptp(u, 0) > 1e-12, np.ptp(u, 0), 1.0)

    def reservoir(rho: float, sigma_in: float) -> recurrence.Reservoir:
        return recurrence.Reservoir(w_in, w, norm, u.mean(0), np.array([rho]), np.array([sigma_in]), np.array([cfg.leak_rate]), cfg.bias_in, cfg.bias_out)

    def setting(axes: list[str], point: list[float]) -> recurrence.Reservoir:
        at = dict(zip(axes, point, strict=True))
        return reservoir(at.get("rho", cfg.rho), 10 ** at["sigma_in"] if "sigma_in" in at else cfg.sigma_in)

    def score(axes: list[str], points: list[list[float]]) -> list[tuple[float, float, int]]:
        found = [validate(setting(axes, p), u, y, cfg, strategy, cfg.tikh) for p in points]
        return [(loss, cfg.tikh, n) for loss, n in found]

    axes, points, found, _ = search.explore(cfg, score)
    best = int(np.argmin([f[0] for f in found]))
    model = setting(axes, points[best])
    rows = np.concatenate([states(model, u), np.full((len(u), 1), cfg.bias_out)], 1)[cfg.n_wash :]
    w_out = ridge.solve(rows.T @ np.concatenate([rows, y[cfg.n_wash :]], 1), cfg.tikh)
    span = np.ptp(data, 0)
    errors, horizon = run_tests(model, w_out, rest, tests, span, float(np.sqrt(((rest / span) ** 2).sum(1).mean())))
    at = {"m_val": 10.0 ** found[best][0], "m_test": float(10.0 ** np.log10(errors + 1e-300).mean()), "horizon": float(horizon.mean())}
    return at | {"rho": float(model.rho[0]), "sigma_in": float(model.sigma_in[0]), "n_folds": found[best][2]}


_MEMBER = "strategy string, seed long, m_val double, m_test double, horizon double, rho double, sigma_in double, n_folds long"


def compare(spark: SparkSession, data: np.ndarray, rest: np.ndarray, cfg: Config, strategies: dict[str, Strategy], seeds: list[int], tests: Tests) -> DataFrame:
    """The member table: (strategy, seed, m_val, m_test, horizon, rho, sigma_in, n_folds). ``data``: (steps, dimensions)
    to train and validate on, ``rest`` to test on. Members don't depend on each other: a lost task repeats its own."""
    rows = [(name, int(s)) for s in seeds for name in strategies]

    def members(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, seed in zip(pdf["strategy"], pdf["seed"], strict=True):
                yield pd.DataFrame([{"strategy": name, "seed": seed, **train(data, rest, cfg.with_(seed=int(seed)), strategies[name], tests)}])

    todo = spark.createDataFrame(rows, "strategy string, seed long")
    return todo.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(members, _MEMBER)


def lorenz_experiment(wash: float = 1.0, train_for: float = 9.0, val: float = 3.0, dt: float = 0.02, windows: int = 50, **settings) -> tuple:
    """(data, rest, configuration, strategies, tests) of the chaotic comparison, times in Lyapunov times. The chaotic
    forms advance by one Lyapunov time; the chaotic walk-forward keeps the regular one's window."""
    steps = lambda x: int(round(x * chaos.LYAPUNOV_TIME / dt))
    one, n_wash, n_train, n_val = steps(1), steps(wash), steps(train_for), steps(val)
    n = n_train + n_val
    tests = Tests(tuple(steps(2) * k for k in range(windows)), one, steps(5), steps(2))
    x, rows = np.array([1.0, 1.0, 1.0]), []
    for _ in range(2000 + n + tests.starts[-1] + tests.n_wash + tests.n_steps + 2):
        rows.append(x)
        x = chaos.rk4(x, dt)
    rows = np.array(rows[2000:])
    own = dict(n_units=100, tikh=1e-11, noise=1e-3, rho_range=(0.1, 1.0), sigma_in_range=(float(np.log10(0.5)), float(np.log10(5.0))), n_grid=5, n_func_evals=49, optimize=("rho", "sigma_in"))
    cfg = Config(3, dt=dt, upsample=1, n_wash=n_wash, t_train=n_train * dt, t_val=n_val * dt, **(own | settings))
    k = folds.plan_counts(n_wash, n_train, n_val, one, 100)
    strategies = {
        "single_shot": Strategy("single_shot", 1), "walk_forward": Strategy("walk_forward", 100),
        "walk_forward_chaotic": Strategy("walk_forward", k["walk_forward_chaotic"], one), "kfold": Strategy("kfold", 100),
        "kfold_chaotic": Strategy("kfold", 100, one), "recycle_chaotic": Strategy("recycle", k["recycle_chaotic"]),
    }
    return rows[:n], rows[n:], cfg, strategies, tests
