"""The Jacobian of the open-loop one-step map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .recurrence import Reservoir, list_array, matrix_of, scan


def open_loop(model: Reservoir, w_out: np.ndarray, r_before: np.ndarray, u: np.ndarray) -> np.ndarray:
    """(rows, n_dim, n_in): of each row's input at its state. Differentiates tanh at the value before the leak."""
    x = np.tanh(model.sigma_in[0] * model.inputs(u) + model.rho[0] * (r_before @ model.w.T))
    slope = model.leak_rate[0] * (1 - x**2)
    inner = model.sigma_in[0] * model.w_in[:, :-1] / model.norm
    return np.einsum("nd,kn,nj->kdj", w_out[:-1], slope, inner)


def jacobians(series: DataFrame, model: Reservoir, w_out: np.ndarray | None, n_in: int, n_wash: int, closed: bool = False) -> DataFrame:
    """(seg_id, t, jac): row-major (n_dim, n_in), from the row n_wash on."""
    if w_out is None:
        raise ValueError("the model must be trained")
    if closed:
        raise NotImplementedError("the closed-loop Jacobian isn't supported")

    def use(it):
        last = np.zeros(model.n_units)
        for b, number, r, _ in it:
            u = matrix_of(b.column(2), n_in)
            before = np.concatenate([last[None], r[:-1]])
            before[number == 0] = 0
            last = r[-1]
            keep = np.flatnonzero(number >= n_wash)
            j = open_loop(model, w_out, before[keep], u[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), list_array(j.reshape(len(keep), -1))], names=["seg_id", "t", "jac"])

    return scan(series, ["seg_id"], model, n_in, use, "seg_id long, t long, jac array<double>")

