"""Synthetic chaotic series: Lorenz-63 by fixed-step Runge-Kutta."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed parameters of the system, and its Lyapunov time.
SIGMA, RHO, BETA = 10.0, 28.0, 8.0 / 3.0
LYAPUNOV_TIME = 1 / 0.906


def lorenz_rate(x: np.ndarray) -> np.ndarray:
    return np.stack([SIGMA * (x[..., 1] - x[..., 0]), x[..., 0] * (RHO - x[..., 2]) - x[..., 1], x[..., 0] * x[..., 1] - BETA * x[..., 2]], -1)


def rk4(x: np.ndarray, dt: float) -> np.ndarray:
    a = lorenz_rate(x)
    b = lorenz_rate(x + dt / 2 * a)
    c = lorenz_rate(x + dt / 2 * b)
    d = lorenz_rate(x + dt * c)
    return x + dt / 6 * (a + 2 * b + 2 * c + d)


def lorenz(spark: SparkSession, segments: int, steps: int, dt: float = 0.02, transient: int = 0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """``segments`` trajectories from the starting points (1 + segment / 10, 1, 1). ``noise`` is relative to each
    dimension's standard deviation; a segment's draws depend on ``seed`` and its number only."""

    def generate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for seg in pdf["id"]:
                x = np.array([1 + seg / 10, 1.0, 1.0])
                for _ in range(transient):
                    x = rk4(x, dt)
                out = np.empty((steps, 3))
                for i in range(steps):
                    out[i] = x
                    x = rk4(x, dt)
                if noise:
                    out += np.random.default_rng([seed, int(seg)]).normal(size=out.shape) * noise * out.std(0)
                yield pd.DataFrame({"seg_id": seg, "t": np.arange(steps), "y": list(out)})

    return spark.range(0, segments, 1, min(segments, 64) or 1).mapInPandas(generate, "seg_id long, t long, y array<double>")
