"""Fitting, validating, forecasting: DataFrame plans around the recurrence."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.metrics import metric
from ..operators import folds as fold_ops
from ..operators import frames, recurrence, ridge, stats, weights


#: An inferred validation window of fewer steps is warned of.
LEAST_WINDOW = 10


@dataclass(frozen=True)
class Prepared:
    """Training pairs (seg_id, t, u, y) from 0 in each segment, test pairs, resolved configuration and statistics."""

    cfg: Config
    train: DataFrame
    test: DataFrame | None
    norm: np.ndarray
    shift: np.ndarray
    summary: dict


@dataclass(frozen=True)
class Model:
    """A trained model; nothing of it changes afterwards."""

    cfg: Config
    w_in: np.ndarray
    w: np.ndarray
    w_out: np.ndarray | None
    norm: np.ndarray
    shift: np.ndarray
    summary: dict = field(default_factory=dict)
    trace: list = field(default_factory=list)

    @property
    def trained(self) -> bool:
        return self.w_out is not None

    def closing_matrix(self) -> np.ndarray:
        """(n_dim, n_units): the least-squares solution X of (the states' part of the readout) X = W."""
        if not self.trained:
            raise ValueError("the model must be trained")
        return np.linalg.lstsq(self.w_out[:-1], self.w, rcond=None)[0]

    def reservoir(self, rho=None, sigma_in=None, leak_rate=None) -> recurrence.Reservoir:
        one = lambda given, own: np.atleast_1d(np.asarray(own if given is None else given, float))
        c = self.cfg
        return recurrence.Reservoir(self.w_in, self.w, self.norm, self.shift, one(rho, c.rho), one(sigma_in, c.sigma_in), one(leak_rate, c.leak_rate), c.bias_in, c.bias_out)


def prepare(series: DataFrame, cfg: Config, add_noise: bool = True) -> Prepared:
    """Stride, project, append parameters, split, pair, normalise. ``series``: (seg_id, t, y[, p]); p holds constant or
    per-row parameters alike. Windows that aren't configured are inferred; both modes keep to their own rules."""
    s = frames.observe(frames.stride(series, cfg.upsample), cfg.observed_idx)
    s = frames.append_row_params(s) if cfg.n_param else s
    n_in, n_obs = cfg.n_dim_in, len(cfg.observed_idx)
    lengths = frames.segment_lengths(s)
    if cfg.mode == "regular":
        shape = lengths.agg(F.min("n_steps"), F.max("n_steps"), F.count(F.lit(1))).first()
        if shape[0] != shape[1]:
            raise ValueError("regular segments must be of one length; use mode='ragged'")
        n = int(shape[0] or 0)
        w = frames.regular_windows(n, cfg.n_wash, None if cfg.t_train is None else cfg.n_train, None if cfg.t_val is None else cfg.n_val)
        cfg = cfg.with_(t_train=w.n_train * cfg.dt_esn, t_val=w.n_val * cfg.dt_esn)
        both = frames.regular_split(s, w)
        train, test = both.filter("role = 'train'"), both.filter("role = 'test'")
        summary = {"mode": "regular", "n_segments": int(shape[2]), "n_steps": n, "n_train": w.n_train, "n_val": w.n_val, "n_test": max(n - w.n_wtv - 1, 0)}
        base = train
    else:
        row = frames.split_summary(lengths, cfg.n_wash, cfg.t_test).first()
        n_val = cfg.n_val if cfg.t_val is not None else int(row.n_val)
        if cfg.t_val is None and n_val < LEAST_WINDOW:
            warnings.warn(f"the inferred validation window has only {n_val} steps: segments hardly outlast the wash-out of {cfg.n_wash}; give longer ones, or t_val", stacklevel=2)
        both = frames.ragged_split(s, cfg.n_wash, cfg.t_test)
        train = both.filter("role = 'train'")
        test = both.filter("role = 'test'") if row.n_test else train
        cfg = cfg.with_(t_val=n_val * cfg.dt_esn, t_train=max(1, int(row.kept_pairs) - n_val) * cfg.dt_esn)
        summary = {"mode": "ragged", **{k: int(row[k]) for k in ("n_segments", "n_dropped", "n_train", "n_test", "kept_pairs")}, "n_val": n_val}
        base = train
    if add_noise and cfg.noise:
        base = frames.add_noise(base, cfg.noise, n_obs, cfg.seed)
    norm, shift = stats.stats_vectors(stats.norm_stats(base, cfg.norm_method, pooled=cfg.mode == "ragged"), n_in, cfg.n_param)
    return Prepared(cfg, base.drop("role"), test.drop("role"), np.array(norm), np.array(shift), summary)


def untrained(cfg: Config, norm=None, shift=None, w_in=None, w=None) -> Model:
    """Matrices that are given are kept, others are drawn from the configuration's seed."""
    n = cfg.n_dim_in
    return Model(
        cfg, weights.input_matrix(cfg) if w_in is None else np.asarray(w_in), weights.reservoir_matrix(cfg) if w is None else np.asarray(w), None,
        np.ones(n) if norm is None else np.asarray(norm), np.zeros(n) if shift is None else np.asarray(shift),
    )


def fit_readout(model: Model, train: DataFrame) -> np.ndarray:
    cfg = model.cfg
    sums = ridge.gram(train, model.reservoir(), cfg.n_dim_in, cfg.n_dim, cfg.n_wash)
    got = ridge.collect_gram(sums, cfg.n_units, cfg.n_dim)
    if not got:
        raise ValueError(f"no training rows are left after {cfg.n_wash} steps of wash-out")
    return ridge.solve(got[0, 0], cfg.tikh)


# ---- validation of candidates


@dataclass(frozen=True)
class Candidates:
    """Settings to validate: one entry each; every one is tried with all ``tikh``. Input scaling may differ too."""

    rho: np.ndarray
    sigma_in: np.ndarray
    leak_rate: np.ndarray
    tikh: tuple[float, ...]

    def __len__(self) -> int:
        return len(self.rho)


def score_recycle(model: Model, train: DataFrame, cands: Candidates, how: str | Callable | None = None) -> DataFrame:
    """(cand, tikh_idx, loss, n_folds): mean metric over all segments' folds.

    One pass gathers the Gram sums of all candidates, one more washes out and forecasts all folds, with the ridge
    candidates side by side, as wash-out doesn't depend on them. The rows are dealt once, or as many times as it takes
    to keep the cores busy, whatever the number of candidates. Parameters are held as in a segment's first row. Truth
    and metric are joins and aggregates."""
    cfg = model.cfg
    many = model.reservoir(cands.rho, cands.sigma_in, cands.leak_rate)
    lengths = train.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_steps"))
    places = fold_ops.recycle(lengths, cfg.n_wash, cfg.n_val, cfg.n_folds)
    blocks = recurrence.blocks_for(train.sparkSession, len(cands), lengths.count())
    sums = ridge.gram(recurrence.in_blocks(train, blocks), many, cfg.n_dim_in, cfg.n_dim, cfg.n_wash, ["cand", "seg_id"], "cand", n_blocks=blocks)
    sums = ridge.collect_gram(sums, cfg.n_units, cfg.n_dim)
    w_out = np.stack([np.stack([ridge.solve(sums[c, 0], t) for t in cands.tikh]) for c in range(len(cands))])
    washed = places.select("seg_id", "fold", F.explode(F.sequence("p", F.col("wash_to") - 1)).alias("t")) if cfg.n_wash else places.limit(0).select("seg_id", "fold", F.col("p").alias("t"))
    wash = train.select("seg_id", "t", "u").join(washed, ["seg_id", "t"]).select("seg_id", "fold", "t", "u")
    hold = None
    if cfg.n_param:
        hold = "held"
        first = train.filter("t = 0").select("seg_id", F.slice("u", len(cfg.observed_idx) + 1, cfg.n_param).alias(hold))
        wash = wash.join(first, "seg_id")
    got = recurrence.forecast(
        recurrence.in_blocks(wash, blocks), many, w_out, cfg.n_dim_in, cfg.n_val, cfg.observed_idx, cfg.n_wash, ["cand", "seg_id", "fold"], "cand", blocks, hold
    )
    # the last washed input t leads to the state t + 1; forecast i to the target of pair t + 1 + i
    truth = train.select(F.col("seg_id").alias("y_seg"), (F.col("t") + 1).alias("y_t"), "y")
    ranges = train.select("seg_id", F.posexplode("y").alias("dim", "x")).groupBy("seg_id", "dim").agg((F.max("x") - F.min("x")).alias("range"))
    ranges = ranges.groupBy(F.col("seg_id").alias("n_seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "range"))), lambda x: x["range"]).alias("norm"))
    rows = got.join(truth, (F.col("seg_id") == F.col("y_seg")) & (F.col("row_t") == F.col("y_t"))).join(ranges, F.col("seg_id") == F.col("n_seg"))
    each = rows.groupBy("cand", F.col("w").alias("tikh_idx"), "seg_id", "fold").agg(metric(how or cfg.validation_metric)(F.col("y"), F.col("yhat"), F.col("norm")).alias("m"))
    return each.groupBy("cand", "tikh_idx").agg(F.avg("m").alias("loss"), F.count(F.lit(1)).alias("n_folds"))


def score_single_series(model: Model, train: DataFrame, cands: Candidates, strategy: str, how: str | Callable | None = None) -> DataFrame:
    """As ``score_recycle`` for one contiguous segment and the strategies of ``folds.SINGLE_SERIES``.

    One open-loop pass serves all folds and candidates: each row's products go to the interval between two fold
    borders, and a fold's sums are those of its intervals. A second pass forecasts from the states at the folds' starts,
    in the tasks that have them."""
    cfg = model.cfg
    shape = train.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")).limit(2).collect()
    if len(shape) != 1:
        raise ValueError(f"{strategy} needs one contiguous series; use 'recycle' for several segments")
    n_post, v = int(shape[0].n) - cfg.n_wash, cfg.n_val
    table = fold_ops.single_series_table(strategy, n_post, v, cfg.n_folds, cfg.val_fold_step)
    if len(table) < cfg.n_folds and strategy != "single_shot":
        warnings.warn(f"{strategy}: {len(table)} of {cfg.n_folds} folds fit in {n_post} steps after wash-out, with {v} steps each", stacklevel=2)
    ranges = [fold_ops.train_ranges(f) for f in table]
    borders = sorted({0, n_post} | {x for rs in ranges for r in rs for x in r})
    many = model.reservoir(cands.rho, cands.sigma_in, cands.leak_rate)
    interval = sum((F.when(F.col("t") - cfg.n_wash >= b, 1).otherwise(0) for b in borders[1:]), F.lit(0)).cast("long")
    blocks = recurrence.blocks_for(train.sparkSession, len(cands), 1)
    rows = recurrence.in_blocks(train.withColumn("part", interval), blocks)
    sums = ridge.collect_gram(ridge.gram(rows, many, cfg.n_dim_in, cfg.n_dim, cfg.n_wash, ["cand", "seg_id"], "cand", "part", blocks), cfg.n_units, cfg.n_dim)
    zero = np.zeros((cfg.n_units + 1, cfg.n_units + 1 + cfg.n_dim))
    prefix = np.stack([np.concatenate([[zero], np.cumsum([sums.get((c, k), zero) for k in range(len(borders) - 1)], 0)]) for c in range(len(cands))])
    at = {b: i for i, b in enumerate(borders)}
    w_out = np.stack([
        np.stack([np.stack([ridge.solve(sum(prefix[c, at[b]] - prefix[c, at[a]] for a, b in rs), t) for t in cands.tikh]) for rs in ranges])
        for c in range(len(cands))
    ])  # candidate, fold, ridge
    seeds = {i0 + cfg.n_wash - 1: f for f, _, _, i0, _ in table}
    got = _forecast_from_states(cfg, rows, many, w_out, seeds, blocks)
    norm = train.select(F.posexplode("y").alias("dim", "x")).groupBy("dim").agg((F.max("x") - F.min("x")).alias("range"))
    norm = F.array(*[F.lit(float(r.range)) for r in norm.orderBy("dim").collect()])
    truth = train.select(F.col("t").alias("y_t"), "y")
    each = got.join(truth, "y_t").groupBy("cand", "tikh_idx", "fold").agg(metric(how or cfg.validation_metric)(F.col("y"), F.col("yhat"), norm).alias("m"))
    return each.groupBy("cand", "tikh_idx").agg(F.avg("m").alias("loss"), F.count(F.lit(1)).alias("n_folds"))


def _forecast_from_states(cfg: Config, rows: DataFrame, many: recurrence.Reservoir, w_out: np.ndarray, seeds: dict[int, int], blocks: int) -> DataFrame:
    """(cand, fold, tikh_idx, y_t, yhat): closed loops from the open-loop states after the rows ``seeds`` (t: fold)."""
    params = None
    if cfg.n_param:
        first = rows.select("u").filter("t = 0").first()["u"]
        params = np.array(first[len(cfg.observed_idx) :], float)[None]
    n_val, n_ridge = cfg.n_val, w_out.shape[2]

    def use(it):
        for b, _, r, c in it:
            t = np.asarray(b.column(2).to_numpy(zero_copy_only=False), np.int64)
            for i in np.flatnonzero(np.isin(t, list(seeds))):
                fold = seeds[int(t[i])]
                y = recurrence.closed_loop(many, w_out[c, fold], np.repeat(r[i][None], n_ridge, 0), n_val, cfg.observed_idx, None if params is None else np.repeat(params, n_ridge, 0), c)
                n = n_ridge * n_val
                columns = [np.full(n, c), np.full(n, fold), np.repeat(np.arange(n_ridge), n_val), np.tile(t[i] + 1 + np.arange(n_val), n_ridge)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in columns], recurrence.list_array(y.reshape(n, -1))], names=["cand", "fold", "tikh_idx", "y_t", "yhat"])

    return recurrence.scan(rows, ["cand", "seg_id"], many, cfg.n_dim_in, use, "cand long, fold long, tikh_idx long, y_t long, yhat array<double>", "cand", blocks)


#: Name -> (model, train, candidates, metric) -> (cand, tikh_idx, loss, n_folds). Callers may add their own.
STRATEGIES: dict[str, Callable] = {
    "recycle": score_recycle,
    **{s: (lambda m, t, c, how=None, s=s: score_single_series(m, t, c, s, how)) for s in fold_ops.SINGLE_SERIES},
}


def best_tikh(scores: DataFrame) -> DataFrame:
    """(cand, tikh_idx, loss, n_folds): each candidate's best ridge, the first on ties; a NaN is never best."""
    loss = F.when(F.isnan("loss"), None).otherwise(F.col("loss"))
    ranked = scores.groupBy("cand").agg(F.min(F.struct(F.coalesce(loss, F.lit(float("inf"))).alias("loss"), "tikh_idx", "n_folds")).alias("b"))
    return ranked.select("cand", "b.tikh_idx", "b.loss", "b.n_folds")


def fit(series: DataFrame, cfg: Config, strategy: str | Callable = "recycle", add_noise: bool = True, w_in=None, w=None) -> Model:
    """Prepare, search if any hyperparameter is to be optimised, then fit the readout on all of train and validation."""
    from .search import optimise

    data = prepare(series, cfg, add_noise)
    model = untrained(data.cfg, data.norm, data.shift, w_in, w)
    trace: list = []
    if data.cfg.searched():
        model, trace = optimise(model, data.train, strategy)
    return Model(model.cfg, model.w_in, model.w, fit_readout(model, data.train), model.norm, model.shift, data.summary, trace)


def forecast_windows(model: Model, series: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """Closed-loop forecasts (seg_id, i0, step, row_t, yhat, y) from ``starts`` (seg_id, i0), each after n_wash rows."""
    if not model.trained:
        raise ValueError("the model must be trained")
    cfg = model.cfg
    s = frames.observe(frames.stride(series, cfg.upsample), cfg.observed_idx)
    s = frames.append_row_params(s) if cfg.n_param else s
    washed = starts.filter(F.lit(cfg.n_wash) > 0).select("seg_id", "i0", F.explode(F.sequence("i0", F.col("i0") + cfg.n_wash - 1)).alias("t"))
    wash = s.join(washed, ["seg_id", "t"]).select("seg_id", "i0", "t", "u")
    got = recurrence.forecast(wash, model.reservoir(), model.w_out[None], cfg.n_dim_in, steps, cfg.observed_idx, cfg.n_wash)
    truth = s.select(F.col("seg_id").alias("y_seg"), F.col("t").alias("y_t"), "y")
    out = got.join(truth, (F.col("seg_id") == F.col("y_seg")) & (F.col("row_t") == F.col("y_t")))
    return out.select("seg_id", "i0", "step", "row_t", "yhat", "y")


def run_test(model: Model, series: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(seg_id, i0, log_nmae, nmse) of closed-loop tests; errors are set against each segment's range."""
    from ..functions.metrics import log_nmae, nmse

    got = forecast_windows(model, series, starts, steps)
    s = frames.stride(series, model.cfg.upsample)
    ranges = s.select("seg_id", F.posexplode("y").alias("dim", "x")).groupBy("seg_id", "dim").agg((F.max("x") - F.min("x")).alias("range"))
    ranges = ranges.groupBy("seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "range"))), lambda x: x["range"]).alias("norm"))
    y, yhat, norm = F.col("y"), F.col("yhat"), F.col("norm")
    return got.join(ranges, "seg_id").groupBy("seg_id", "i0").agg(log_nmae(y, yhat, norm).alias("log_nmae"), nmse(y, yhat).alias("nmse"))


def one_step(model: Model, series: DataFrame) -> DataFrame:
    """Open-loop forecasts (seg_id, t, yhat, y) of the row after each, from the row n_wash on."""
    cfg = model.cfg
    s = frames.pairs(frames.observe(frames.stride(series, cfg.upsample), cfg.observed_idx))
    s = frames.append_row_params(s) if cfg.n_param else s
    r = recurrence.states(s, model.reservoir(), cfg.n_dim_in, cfg.n_wash)
    return readout(r, model.w_out, cfg.bias_out).join(s.select("seg_id", "t", "y"), ["seg_id", "t"])


def readout(states: DataFrame, w_out: np.ndarray, bias_out: float) -> DataFrame:
    """(seg_id, t, yhat) of (seg_id, t, r), as column expressions."""
    from ..functions.vectors import dot, literal

    with_bias = F.concat("r", F.array(F.lit(float(bias_out))))
    return states.select("seg_id", "t", F.array(*[dot(with_bias, literal(w_out[:, d])) for d in range(w_out.shape[1])]).alias("yhat"))


def training_summary(spark: SparkSession, model: Model) -> DataFrame:
    """One row: how the data was split, and the settings found; of the best evaluation its loss and how many folds it
    came from (null without a search), which are fewer than asked for where segments are short."""
    if not model.trained:
        raise RuntimeError("the model hasn't been trained")
    cfg, best = model.cfg, min((x for x in model.trace if x["loss"] == x["loss"]), key=lambda x: x["loss"], default={})
    settings = {k: float(getattr(cfg, k)) for k in ("rho", "sigma_in", "tikh", "leak_rate")}
    row = {"n_units": cfg.n_units, **settings, **model.summary, "n_evals": len(model.trace), "n_folds_asked": cfg.n_folds, "n_folds": best.get("n_folds"), "loss": best.get("loss")}
    kinds = {int: "long", float: "double", str: "string"}
    types = {k: kinds.get(type(v), "long") for k, v in row.items()} | {"loss": "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in types.items()))


def search_table(spark: SparkSession, model: Model) -> DataFrame:
    """(eval, <axes>, tikh, loss, n_folds, is_grid) of a search, a row each evaluation: the surface that it saw."""
    if not model.trace:
        raise ValueError("the model hasn't been searched for")
    kinds = {"eval": "long", "n_folds": "long", "is_grid": "boolean"}
    names = list(model.trace[0])
    rows = [tuple(int(x[k]) if kinds.get(k) == "long" else bool(x[k]) if k == "is_grid" else float(x[k]) for k in names) for x in model.trace]
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'double')}" for k in names))


def readout_table(spark: SparkSession, model: Model) -> DataFrame:
    """(unit, dim, weight) of a trained readout; the unit after the last is the bias."""
    if not model.trained:
        raise ValueError("the model must be trained")
    return spark.createDataFrame([(i, d, float(x)) for (i, d), x in np.ndenumerate(model.w_out)], "unit long, dim long, weight double")
