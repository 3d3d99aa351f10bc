"""Ridge regression of the readout from distributed Gram sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recurrence import Reservoir, matrix_of, scan


def gram(pairs: DataFrame, model: Reservoir, n_in: int, n_dim: int, n_wash: int, keys: Sequence[str] = ("seg_id",), cand: str | None = None, part: str | None = None, n_blocks: int = 1) -> DataFrame:
    """Sums of [r; b][r; b]' and [r; b] y' over all rows after wash-out: (cand, part, i, j, v), j counting on into y.

    Each task adds its rows up and sends (n + 1)(n + 1 + n_dim) numbers for each candidate and part that it saw.
    ``pairs``: keys, t, u, y, and the whole number ``part`` if sums are wanted by part. ``cand``: as of ``scan``."""
    n = model.n_units + 1

    def use(it):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b, number, r, c in it:
            keep = number >= n_wash
            a = np.concatenate([r, np.full((len(r), 1), model.bias_out)], 1)[keep]
            y = matrix_of(b.column(len(keys) + 2), n_dim)[keep]
            whole = np.concatenate([a, y], 1)
            p = np.asarray(b.column(len(keys) + 3).to_numpy(zero_copy_only=False), np.int64)[keep] if part else np.zeros(len(a), np.int64)
            for k in np.unique(p).tolist():
                rows = p == k
                sums[c, k] = sums.get((c, k), 0) + a[rows].T @ whole[rows]
        i, j = np.divmod(np.arange(n * (n + n_dim)), n + n_dim)
        for (c, p), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, c)), pa.array(np.full(v.size, p)), pa.array(i), pa.array(j), pa.array(v.ravel())], names=["cand", "part", "i", "j", "v"])

    each = scan(pairs, list(keys), model, n_in, use, "cand long, part long, i long, j long, v double", cand, n_blocks, ["y", *[part] * bool(part)])
    return each.groupBy("cand", "part", "i", "j").agg(F.sum("v").alias("v"))


def collect_gram(sums: DataFrame, n_units: int, n_dim: int) -> dict[tuple[int, int], np.ndarray]:
    """(cand, part) -> (n_units + 1, n_units + 1 + n_dim). The model's size, whatever the data's."""
    n = n_units + 1
    got = sums.toArrow()
    out: dict[tuple[int, int], np.ndarray] = {}
    c, p, i, j, v = (got.column(k).to_numpy() for k in ("cand", "part", "i", "j", "v"))
    for k in map(tuple, np.unique(np.stack([c, p], 1), axis=0).tolist() if len(c) else []):
        rows = (c == k[0]) & (p == k[1])
        m = np.zeros((n, n + n_dim))
        m[i[rows], j[rows]] = v[rows]
        out[k] = m
    return out


def solve(sums: np.ndarray, tikh: float) -> np.ndarray:
    """(n_units + 1, n_dim); the ridge is added to the whole diagonal, the bias's too."""
    n = len(sums)
    return np.linalg.solve(sums[:, :n] + tikh * np.eye(n), sums[:, n:])
