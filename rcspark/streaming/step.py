"""Streaming forecasts (an extension): each key's reservoir state lives in the stream's state store.

Rows of a key must arrive in order of ``t``; rows at or before the last one seen are dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.model import Model

OUTPUT = "seg_id long, t long, yhat array<double>"
STATE = "r array<double>, t long"


def stream_forecast(rows: DataFrame, model: Model) -> DataFrame:
    """(seg_id, t, yhat): the forecast of row t + 1 after each row (seg_id, t, u)."""
    if not model.trained:
        raise ValueError("the model must be trained")
    reservoir, w_out = model.reservoir(), model.w_out

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r, last = (np.array(state.get[0]), state.get[1]) if state.exists else (np.zeros(reservoir.n_units), -1)
        pdf = pd.concat(list(batches)).sort_values("t")
        ts, out = [], []
        for t, u in zip(pdf["t"], pdf["u"], strict=True):
            if t <= last:
                continue
            r = reservoir.advance(r[None], reservoir.inputs(np.asarray(u, float)[None]))[0]
            ts.append(int(t))
            out.append(reservoir.readout(r[None], w_out)[0].tolist())
            last = int(t)
        state.update((r.tolist(), last))
        yield pd.DataFrame({"seg_id": [key[0]] * len(ts), "t": ts, "yhat": out})

    return rows.groupBy("seg_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
