"""The reservoir's recurrence over ordered rows, in bounded memory.

Rows are dealt by segment and sorted by time, and each task goes through its batches once: it carries only the last
segment's state from batch to batch, so a segment may be of any length. Within a batch all segments advance in lock
step, one matrix product for their k-th rows together. Nothing can be pushed below this step, so select rows and
columns before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal


@dataclass(frozen=True)
class Reservoir:
    """Matrices and settings of the open-loop map; rho, sigma_in and leak_rate by candidate."""

    w_in: np.ndarray
    w: np.ndarray
    norm: np.ndarray
    shift: np.ndarray
    rho: np.ndarray = field(default_factory=lambda: np.array([0.9]))
    sigma_in: np.ndarray = field(default_factory=lambda: np.array([1e-3]))
    leak_rate: np.ndarray = field(default_factory=lambda: np.array([1.0]))
    bias_in: float = 0.1
    bias_out: float = 1.0

    @property
    def n_units(self) -> int:
        return len(self.w)

    def inputs(self, u: np.ndarray, norm: np.ndarray | None = None, shift: np.ndarray | None = None) -> np.ndarray:
        """W_in [(u - shift) / norm; bias] of rows ``u``."""
        v = (u - (self.shift if shift is None else shift)) / (self.norm if norm is None else norm)
        return v @ self.w_in[:, :-1].T + self.bias_in * self.w_in[:, -1]

    def advance(self, r: np.ndarray, driven: np.ndarray, cand: np.ndarray | int = 0) -> np.ndarray:
        """One step of states ``r`` (rows) under W_in u (rows)."""
        cand = np.asarray(cand).reshape(-1)
        x = np.tanh(self.sigma_in[cand, None] * driven + self.rho[cand, None] * (r @ self.w.T))
        leak = self.leak_rate[cand, None]
        return np.where(leak == 1.0, x, (1 - leak) * r + leak * x)

    def readout(self, r: np.ndarray, w_out: np.ndarray) -> np.ndarray:
        """Of rows ``r``; w_out: (n_units + 1, n_dim), or one for each row."""
        if w_out.ndim == 2:
            return r @ w_out[:-1] + self.bias_out * w_out[-1]
        return np.einsum("kn,knd->kd", r, w_out[:, :-1]) + self.bias_out * w_out[:, -1]


def lock_step(group: np.ndarray, driven: np.ndarray, cand: np.ndarray, r0: np.ndarray, advance: Callable) -> np.ndarray:
    """States after each row. group: the row's segment as a number from 0, rows of a segment being adjacent and in
    order; r0: a state for each segment."""
    n = len(group)
    out = np.empty((n, r0.shape[1]))
    if not n:
        return out
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")  # longest first: the active ones are always a prefix
    starts, sizes, r = starts[order], sizes[order], r0[order].copy()
    for k in range(int(sizes[0])):
        active = int(np.searchsorted(-sizes, -k, "left"))
        rows = starts[:active] + k
        r[:active] = advance(r[:active], driven[rows], cand[rows])
        out[rows] = r[:active]
    return out


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def list_array(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] if x.ndim == 2 and x.shape[1] else 1)[: len(x) + 1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def dealt(df: DataFrame, keys: Sequence[str], order: str = "t") -> DataFrame:
    """Rows of a key in one partition, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


class Carry:
    """The states at the end of the last batch."""

    def __init__(self):
        self.key, self.state, self.seen = None, None, 0

    def enter(self, keys: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment number of each row, its start state, rows of it before this batch)."""
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        group = np.cumsum(new) - 1
        r0 = np.zeros((group[-1] + 1, n_units))
        before = np.zeros(group[-1] + 1, np.int64)
        if self.key is not None and (keys[0] == self.key).all():
            r0[0], before[0] = self.state, self.seen
        return group, r0, before

    def leave(self, keys: np.ndarray, group: np.ndarray, before: np.ndarray, states: np.ndarray) -> None:
        self.key, self.state = keys[-1], states[-1]
        self.seen = int(before[-1] + np.count_nonzero(group == group[-1]))


def blocks_for(spark: SparkSession, n_cand: int, n_keys: int) -> int:
    """Into how many blocks candidates are dealt: one while there are keys enough to keep all cores busy, as each
    block needs the rows once more."""
    return max(1, min(n_cand, -(-spark.sparkContext.defaultParallelism // max(n_keys, 1))))


def in_blocks(df: DataFrame, n_blocks: int) -> DataFrame:
    """``df`` for each block of candidates, which ``cand`` numbers."""
    return df.withColumn("cand", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))


def scan(df: DataFrame, keys: Sequence[str], model: Reservoir, n_in: int, use: Callable, schema: str, cand: str | None = None, n_blocks: int = 1, extra: Sequence[str] = ()) -> DataFrame:
    """Drives the reservoir from r = 0 along each key's rows. ``df``: keys, t, u, and ``extra`` columns.

    ``use(batches)`` gets an iterator of (record batch, row number in the key, states, candidate) and yields record
    batches of ``schema``. Keys are whole numbers. ``cand``: the key with the block of candidates that a row is for,
    of ``n_blocks``; candidate c is of block c modulo n_blocks, and a task goes through a block's candidates for each
    batch, holding one state of each. Without it there is one candidate."""
    cols = [*keys, "t", "u", *extra]
    place = list(keys).index(cand) if cand else None
    n_cand = len(model.rho)

    def driven(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        carries: dict[int, Carry] = {}
        for whole in it:
            if not whole.num_rows:
                continue
            block = np.asarray(whole.column(place).to_numpy(zero_copy_only=False), np.int64) if cand else np.zeros(whole.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), whole.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                b = whole.slice(at, end - at)
                key = np.stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(len(keys))], 1)
                inputs = model.inputs(matrix_of(b.column(len(keys) + 1), n_in))
                own = range(int(block[at]), n_cand, n_blocks) if cand else [0]
                carries = {c: carries.get(c) or Carry() for c in own}
                for c in own:
                    group, r0, before = carries[c].enter(key, model.n_units)
                    states = lock_step(group, inputs, np.full(len(key), c), r0, model.advance)
                    number = before[group] + np.arange(len(group)) - np.searchsorted(group, np.arange(group[-1] + 1))[group]
                    carries[c].leave(key, group, before, states)
                    yield b, number, states, c

    return dealt(df.select(*cols), keys).mapInArrow(lambda it: use(driven(it)), schema)


def states(series: DataFrame, model: Reservoir, n_in: int, n_wash: int) -> DataFrame:
    """(seg_id, t, r): the state after each input from the row n_wash on, the segment's rows before it washing out."""

    def use(it):
        for b, number, r, _ in it:
            keep = number >= n_wash
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), list_array(r[keep])], names=["seg_id", "t", "r"])

    return scan(series, ["seg_id"], model, n_in, use, "seg_id long, t long, r array<double>")


# ---- the same without Python, for small reservoirs


def native_states(series: DataFrame, model: Reservoir, n_wash: int) -> DataFrame:
    """As ``states``, folded with ``aggregate`` over each segment's collected rows: for tens of units, and segments
    that fit a row."""
    n = model.n_units
    w_in, w = [literal(x) for x in model.w_in], [literal(x) for x in model.w]
    sigma, rho, leak = float(model.sigma_in[0]), float(model.rho[0]), float(model.leak_rate[0])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.zip_with("u", F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(m)).alias("m")) for s, m in zip(model.shift, model.norm, strict=True)]), lambda x, z: (x - z["s"]) / z["m"])
    rows = series.select("seg_id", "t", F.concat(scaled, F.array(F.lit(model.bias_in))).alias("v"))

    def step(acc: Column, x: Column) -> Column:
        r = acc["r"]
        new = [F.tanh(F.lit(sigma) * dot(w_in[i], x["v"]) + F.lit(rho) * dot(w[i], r)) for i in range(n)]
        if leak != 1.0:
            new = [F.lit(1 - leak) * F.get(r, F.lit(i)) + F.lit(leak) * new[i] for i in range(n)]
        now = F.array(*new)
        return F.struct(now.alias("r"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), now.alias("r")))).alias("out"))

    start = F.struct(literal([0.0] * n).alias("r"), F.array().cast("array<struct<t:bigint,r:array<double>>>").alias("out"))
    grouped = rows.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("rows"))
    all_ = grouped.select("seg_id", F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("out"))
    return all_.select("seg_id", F.explode(F.slice("out", F.lit(n_wash + 1), F.greatest(F.size("out") - n_wash, F.lit(0)))).alias("x")).select("seg_id", "x.t", "x.r")


# ---- closed loop


def feedback(y: np.ndarray, observed: Sequence[int], params: np.ndarray | None) -> np.ndarray:
    """Outputs as next inputs: the observed dimensions, and parameters held fixed."""
    u = y[:, list(observed)]
    return u if params is None or not params.shape[1] else np.concatenate([u, params], 1)


def closed_loop(model: Reservoir, w_out: np.ndarray, r: np.ndarray, steps: int, observed: Sequence[int], params: np.ndarray | None = None, cand: np.ndarray | int = 0) -> np.ndarray:
    """(rows, steps, n_dim): forecasts from states ``r``; the first follows the state's own readout as input."""
    y = model.readout(r, w_out)
    out = np.empty((len(r), steps, y.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(steps):
            r = model.advance(r, model.inputs(feedback(y, observed, params)), cand)
            y = model.readout(r, w_out)
            out[:, k] = y
    return out


def forecast(
    windows: DataFrame, model: Reservoir, w_out: np.ndarray, n_in: int, steps: int, observed: Sequence[int], n_wash: int, keys: Sequence[str] = ("seg_id", "i0"),
    cand: str | None = None, n_blocks: int = 1, hold: str | None = None,
) -> DataFrame:
    """Washes out along each key's n_wash rows, then forecasts ``steps`` steps: (keys, w, step, row_t, yhat).

    ``windows``: keys, t, u, of n_wash rows for each key; shorter ones give nothing. w_out: (n, n_units + 1, n_dim), one
    or several readouts w, by candidate if ``cand`` names a key, which has the blocks of candidates and becomes the
    candidate: (candidates, n, ...). Parameters are held as in the column ``hold``, else as in the last washed row.
    Forecast i belongs to the row row_t = last washed row + 2 + i of the series, as the last readout itself is the row
    after it.
    """
    w_out = np.asarray(w_out)
    place = list(keys).index(cand) if cand else None
    names = [*keys, "w", "step", "row_t", "yhat"]
    n_param = n_in - len(observed)

    def use(it):
        for b, number, r, c in it:
            end = np.flatnonzero(number == n_wash - 1)
            if not len(end):
                continue
            key = np.stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64)[end] for i in range(len(keys))], 1)
            if cand:
                key[:, place] = c
            t = np.asarray(b.column(len(keys)).to_numpy(zero_copy_only=False), np.int64)[end]
            held = None
            if n_param:
                held = matrix_of(b.column(len(keys) + 2), n_param)[end] if hold else matrix_of(b.column(len(keys) + 1), n_in)[end][:, len(observed) :]
            outs = w_out[c] if cand else w_out
            n_w = len(outs)
            rep = np.repeat(np.arange(len(end)), n_w)
            y = closed_loop(model, np.concatenate([outs] * len(end)), r[end][rep], steps, observed, None if held is None else held[rep], c)
            at = np.repeat(rep, steps)
            step = np.tile(np.arange(steps), len(rep))
            columns = [pa.array(key[at, i]) for i in range(len(keys))]
            columns += [pa.array(np.repeat(np.tile(np.arange(n_w), len(end)), steps)), pa.array(step), pa.array(t[at] + 2 + step), list_array(y.reshape(-1, y.shape[2]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{k} long" for k in names[:-1]) + ", yhat array<double>"
    return scan(windows, list(keys), model, n_in, use, schema, cand, n_blocks, [hold] if hold else ())
