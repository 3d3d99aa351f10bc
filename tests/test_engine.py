"""Identities of the engine against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rcspark.config import Config
from rcspark.functions import metrics
from rcspark.operators import folds, frames, jacobian, recurrence, ridge, stats, weights
from rcspark.plans import ensemble, members, model as plans, search
from rcspark.sources import chaos, store


def series(spark, lengths, n_dim, seed=0, p=None):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        y = np.cumsum(rng.normal(size=(n, n_dim)), 0) * 0.1
        rows += [(s, t, y[t].tolist(), *([[float(p[s])]] if p else [])) for t in range(n)]
    return spark.createDataFrame(rows, "seg_id long, t long, y array<double>" + ", p array<double>" * bool(p)).repartition(5)


def by_segment(df, column):
    out = {}
    for r in df.orderBy("seg_id", "t").collect():
        out.setdefault(r.seg_id, []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def plain_states(m, u):
    r, out = np.zeros(m.n_units), []
    for x in u:
        new = np.tanh(m.sigma_in[0] * m.w_in @ np.append((x - m.shift) / m.norm, m.bias_in) + m.rho[0] * m.w @ r)
        r = (1 - m.leak_rate[0]) * r + m.leak_rate[0] * new
        out.append(r)
    return np.array(out)


def reservoir(n, n_in, leak=1.0, seed=0):
    cfg = Config(n_in, n_units=n, seed=seed)
    return recurrence.Reservoir(weights.input_matrix(cfg), weights.reservoir_matrix(cfg), np.full(n_in, 2.0), np.full(n_in, 0.3), np.array([0.9]), np.array([0.5]), np.array([leak]))


@pytest.mark.parametrize("leak", [1.0, 0.6])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_states_are_the_recurrence_whatever_the_batches(spark, leak, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        s = frames.observe(series(spark, [3, 40, 1, 25, 60], 2), [0, 1])
        m = reservoir(12, 2, leak)
        u = by_segment(s, "u")
        for got in (by_segment(recurrence.states(s, m, 2, 4), "r"), by_segment(recurrence.native_states(s, m, 4), "r")):
            assert set(got) == {1, 3, 4}
            for k, r in got.items():
                assert np.allclose(r, plain_states(m, u[k])[4:], atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gram_sums_are_products_of_the_states(spark):
    p = frames.pairs(frames.observe(series(spark, [30, 50, 20], 2), [0]))
    m = reservoir(6, 1)
    got = ridge.collect_gram(ridge.gram(p, m, 1, 2, 5), 6, 2)[0, 0]
    u, y = by_segment(p, "u"), by_segment(p, "y")
    a = np.concatenate([np.c_[plain_states(m, u[k])[5:], np.ones(len(u[k]) - 5)] for k in sorted(u)])
    z = np.concatenate([y[k][5:] for k in sorted(u)])
    assert np.allclose(got, a.T @ np.c_[a, z])
    w = ridge.solve(got, 1e-3)
    assert np.allclose((a.T @ a + 1e-3 * np.eye(7)) @ w, a.T @ z)


def test_reservoir_has_unit_spectral_radius_and_streams_are_apart():
    for seed in range(5):
        cfg = Config(3, n_units=20, seed=seed)
        w = weights.reservoir_matrix(cfg)
        assert abs(weights.spectral_radius(w) - 1) < 1e-9
        assert (weights.reservoir_matrix(cfg) == w).all()
    w_in = weights.input_matrix(Config(3, n_param=2, n_units=50))
    assert ((w_in[:, [0, 1, 2, 5]] != 0).sum(1) == 1).all() and (w_in[:, 3:5] != 0).all()
    assert (weights.input_matrix(Config(3, win_type="dense")) != 0).all()
    with pytest.raises(ValueError):
        weights.input_matrix(Config(3, win_type="other"))


@pytest.mark.parametrize("leak", [1.0, 0.6])
def test_jacobian_against_central_differences(spark, leak):
    m, rng = reservoir(15, 3, leak), np.random.default_rng(0)
    w_out, r, u = rng.normal(size=(16, 3)), rng.normal(size=(1, 15)) * 0.3, rng.normal(size=(1, 3))
    step = lambda x: m.readout(m.advance(r, m.inputs(x)), w_out)[0]
    numeric = np.stack([(step(u + e) - step(u - e)) / 2e-6 for e in 1e-6 * np.eye(3)], 1)
    assert np.allclose(jacobian.open_loop(m, w_out, r, u)[0], numeric, rtol=1e-5, atol=1e-8)
    s = frames.observe(series(spark, [12, 9], 3), [0, 1, 2])
    got, inputs = by_segment(jacobian.jacobians(s, m, w_out, 3, 2), "jac"), by_segment(s, "u")
    for k, j in got.items():
        states = np.vstack([np.zeros(15), plain_states(m, inputs[k])])
        assert np.allclose(j, jacobian.open_loop(m, w_out, states[2:-1], inputs[k][2:]).reshape(len(j), -1))
    with pytest.raises(NotImplementedError):
        jacobian.jacobians(s, m, w_out, 3, 2, closed=True)
    with pytest.raises(ValueError):
        jacobian.jacobians(s, m, None, 3, 2)


def test_ragged_split_keeps_whole_segments(spark):
    s = series(spark, [15, 20, 500, 30, 18], 2)
    data = plans.prepare(s, Config(2, n_wash=3, upsample=1, t_train=100.0, t_val=5.0))
    assert data.train.groupBy("seg_id").count().orderBy("seg_id").collect() == [(0, 14), (1, 19), (2, 499), (3, 29)]
    assert data.test.count() == 17
    assert plans.prepare(series(spark, [40] * 6, 3), Config(3, n_wash=5, upsample=1, t_val=5.0, t_test=0.0)).summary["n_test"] == 0
    with pytest.raises(ValueError):
        plans.prepare(s, Config(2, n_wash=600, upsample=1))


def test_windows_are_inferred(spark):
    lengths = [40, 45, 50, 55, 60, 42, 48, 52, 58, 44]
    got = plans.prepare(series(spark, lengths, 2), Config(2, n_wash=5, upsample=1))
    assert got.summary["n_train"] == 8 and got.summary["n_test"] == 2 and got.cfg.n_val == int(np.median(lengths)) - 5 - 1
    w = frames.regular_windows(200, 5)
    assert (w.n_wtv, w.n_val) == (160, 32)
    one = plans.prepare(series(spark, [200], 2), Config(2, mode="regular", n_wash=5, upsample=1))
    assert one.summary["n_test"] == 39
    with pytest.raises(ValueError):
        frames.regular_windows(50, 5, 40, 20)


def test_noise_is_repeatable_and_scaled(spark):
    s = frames.observe(series(spark, [2000], 2), [0, 1])
    a, b = (by_segment(frames.add_noise(s, 0.1, 2, 7), "u")[0] for _ in range(2))
    clean = by_segment(s, "u")[0]
    assert (a == b).all() and not np.allclose(a, by_segment(frames.add_noise(s, 0.1, 2, 8), "u")[0])
    assert np.allclose((a - clean).std(0), 0.1 * clean.std(0), rtol=0.1)


def test_prefix_sums_and_fold_ranges():
    for strategy in folds.SINGLE_SERIES:
        for f in folds.single_series_table(strategy, 100, 10, 5):
            rows = {x for a, b in folds.train_ranges(f) for x in range(a, b)}
            val = set(range(f[3], f[4]))
            assert rows and not rows & val and len(val) == 10 and max(val) < 100
            assert strategy != "kfold" or len(rows) == 90
    assert folds.single_series_table("walk_forward", 100, 10, 5) == folds.single_series_table("walk_forward", 100, 10, 5, 10)
    assert len(folds.single_series_table("kfold", 100, 10, 100, 3)) > len(folds.single_series_table("kfold", 100, 10, 100))
    with pytest.raises(ValueError):
        folds.single_series_table("kfold", 10, 10, 3)


@pytest.mark.parametrize("strategy", folds.SINGLE_SERIES)
def test_single_series_scores_against_plain_numpy(spark, strategy):
    p = frames.pairs(frames.observe(series(spark, [120], 2), [0, 1]))
    cfg = Config(2, n_units=10, n_wash=5, upsample=1, t_val=12.0, n_folds=3, optimize=(), noise=0.0)
    m = plans.untrained(cfg, [2.0, 2.0], [0.3, 0.3])
    cands = plans.Candidates(np.array([0.9, 0.5]), np.array([0.5, 0.2]), np.array([1.0, 0.7]), (1e-3, 1e-1))
    got = {(r.cand, r.tikh_idx): r.loss for r in plans.score_single_series(m, p, cands, strategy).collect()}
    u, y = by_segment(p, "u")[0], by_segment(p, "y")[0]
    for c in range(2):
        one = m.reservoir(cands.rho[c], cands.sigma_in[c], cands.leak_rate[c])
        states = plain_states(one, u)
        a, z, norm = np.c_[states, np.ones(len(states))][5:], y[5:], y.max(0) - y.min(0)
        for k, t in enumerate(cands.tikh):
            losses = []
            for f in folds.single_series_table(strategy, len(z), 12, 3):
                rows = np.concatenate([np.arange(x, b) for x, b in folds.train_ranges(f)])
                w = np.linalg.solve(a[rows].T @ a[rows] + t * np.eye(11), a[rows].T @ z[rows])
                pred = recurrence.closed_loop(one, w, states[5 + f[3] - 1][None], 12, [0, 1])[0]
                losses.append(np.log10(np.abs(pred - z[f[3] : f[4]]).mean() / np.abs(norm).mean()))
            assert got[c, k] == pytest.approx(np.mean(losses), abs=1e-6)


def test_candidates_score_alike_in_any_number_of_blocks(spark, monkeypatch):
    s = frames.observe(series(spark, [60, 70, 40], 2), [0, 1])
    p = frames.pairs(s)
    m = plans.untrained(Config(2, n_units=8, n_wash=5, upsample=1, t_val=6.0, n_folds=3, optimize=(), noise=0.0), [2.0, 2.0], [0.3, 0.3])
    cands = plans.Candidates(np.array([0.9, 0.5, 0.7]), np.array([0.5, 0.2, 0.4]), np.array([1.0, 0.7, 0.5]), (1e-3, 1e-1))
    rows = lambda: sorted((r.cand, r.tikh_idx, round(r.loss, 9), r.n_folds) for r in plans.score_recycle(m, p, cands).collect())
    found = []
    for blocks in (1, 2, 3):
        monkeypatch.setattr(recurrence, "blocks_for", lambda *_, n=blocks: n)
        found.append(rows())
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    monkeypatch.undo()
    cores = spark.sparkContext.defaultParallelism
    assert [recurrence.blocks_for(spark, 25, n) for n in (1, cores, 10 * cores)] == [min(25, cores), 1, 1]


def test_probes_hold_the_first_rows_parameter(spark):
    s = series(spark, [40], 1).withColumn("p", F.array((F.col("t") >= 15).cast("double")))
    p = frames.pairs(frames.append_row_params(frames.observe(s, [0])))
    m = plans.untrained(Config(1, n_param=1, n_units=6, n_wash=5, upsample=1, t_val=5.0, n_folds=2, optimize=(), noise=0.0), [2.0, 1.0], [0.3, 0.0])
    cands = plans.Candidates(np.array([0.9]), np.array([0.5]), np.array([1.0]), (1e-2,))
    got = plans.score_recycle(m, p, cands).first().loss
    u, y = by_segment(p, "u")[0], by_segment(p, "y")[0]
    one = m.reservoir()
    states = plain_states(m.reservoir(0.9, 0.5, 1.0), u)
    a = np.c_[states, np.ones(len(states))][5:]
    w = np.linalg.solve(a.T @ a + 1e-2 * np.eye(7), a.T @ y[5:])
    one = m.reservoir(0.9, 0.5, 1.0)
    losses = []
    for start in (0, len(u) - 10):  # the second washes out on a parameter of 1
        r = plain_states(one, u[start : start + 5])[-1][None]
        pred = recurrence.closed_loop(one, w, r, 5, [0], np.array([[0.0]]))[0]
        losses.append(np.log10(np.abs(pred - y[start + 5 : start + 10]).mean() / np.ptp(y)))
    assert got == pytest.approx(np.mean(losses), abs=1e-9)


def test_short_windows_and_few_folds_are_warned_of(spark):
    with pytest.warns(UserWarning, match="validation window"):
        plans.prepare(series(spark, [12, 13, 14], 1), Config(1, n_units=5, n_wash=5, upsample=1, noise=0.0))
    p = frames.pairs(frames.observe(series(spark, [60], 1), [0]))
    m = plans.untrained(Config(1, n_units=5, n_wash=5, upsample=1, t_val=20.0, n_folds=9, noise=0.0))
    with pytest.warns(UserWarning, match="2 of 9 folds"):
        plans.score_single_series(m, p, plans.Candidates(*[np.ones(1)] * 3, (1e-3,)), "kfold").collect()


def test_closing_matrix_solves_for_the_reservoirs(spark):
    m = plans.fit(series(spark, [80, 70], 2), Config(2, n_units=8, n_wash=5, upsample=1, t_val=8.0, optimize=(), tikh=1e-3, noise=0.0))
    x = m.closing_matrix()
    assert x.shape == (2, 8) and np.allclose(m.w_out[:-1].T @ (m.w_out[:-1] @ x - m.w), 0, atol=1e-8)
    with pytest.raises(ValueError):
        plans.untrained(m.cfg).closing_matrix()


@pytest.mark.parametrize("how", ["recycle", *folds.SINGLE_SERIES])
def test_members_are_scored_as_the_distributed_strategies_do(spark, how):
    p = frames.pairs(frames.observe(series(spark, [120], 2), [0, 1]))
    cfg = Config(2, n_units=10, n_wash=5, upsample=1, t_val=12.0, n_folds=3, optimize=(), noise=0.0)
    m = plans.untrained(cfg, [2.0, 2.0], [0.3, 0.3])
    cands = plans.Candidates(np.array([0.6]), np.array([0.4]), np.array([0.8]), (1e-3,))
    want = plans.STRATEGIES[how](m, p, cands).first()
    got = members.validate(m.reservoir(0.6, 0.4, 0.8), by_segment(p, "u")[0], by_segment(p, "y")[0], cfg, members.Strategy(how, 3), 1e-3)
    assert got[0] == pytest.approx(want.loss, abs=1e-6) and got[1] == want.n_folds


def test_a_comparison_of_strategies(spark):
    data, rest, cfg, strategies, tests = members.lorenz_experiment(windows=4, n_units=30, n_grid=2, n_func_evals=5)
    assert {k: s.n_folds for k, s in strategies.items()} == {"single_shot": 1, "walk_forward": 100, "walk_forward_chaotic": 7, "kfold": 100, "kfold_chaotic": 100, "recycle_chaotic": 9}
    few = {k: strategies[k] for k in ("walk_forward", "recycle_chaotic")}
    rows = members.compare(spark, data, rest, cfg, few, [1, 2], tests).collect()
    assert {(r.strategy, r.seed) for r in rows} == {(k, s) for k in few for s in (1, 2)}
    assert {r.strategy: r.n_folds for r in rows} == {"walk_forward": 3, "recycle_chaotic": 9}
    assert all(0 < r.m_val < 10 and 0 < r.m_test and 1 <= r.horizon <= tests.n_steps and 0.1 <= r.rho <= 1.0 for r in rows)
    one = members.train(data, rest, cfg.with_(seed=2), few["walk_forward"], tests)
    assert next(r.m_val for r in rows if (r.strategy, r.seed) == ("walk_forward", 2)) == pytest.approx(one["m_val"])


def test_single_series_needs_one_segment(spark):
    p = frames.pairs(frames.observe(series(spark, [50, 50], 1), [0]))
    m = plans.untrained(Config(1, n_units=5, n_wash=5, upsample=1, t_val=5.0))
    with pytest.raises(ValueError):
        plans.score_single_series(m, p, plans.Candidates(*[np.ones(1)] * 3, (1e-3,)), "kfold")


def test_search_grid_trace_and_choice(spark):
    s = series(spark, [80, 90, 70], 2)
    cfg = Config(2, n_units=12, n_wash=5, upsample=1, t_val=10.0, n_folds=2, n_func_evals=6, n_grid=2, noise=0.0, optimize=("rho", "sigma_in", "leak_rate", "tikh"), tikh_range=(1e-4, 1e-2))
    m = plans.fit(s, cfg)
    assert len(m.trace) == 6 and m.trained
    assert min(x["loss"] for x in m.trace) == m.trace[int(np.argmin([x["loss"] for x in m.trace]))]["loss"]
    best = min(m.trace, key=lambda x: x["loss"])
    assert m.cfg.rho == pytest.approx(best["rho"]) and m.cfg.sigma_in == pytest.approx(10 ** best["sigma_in"]) and m.cfg.tikh == best["tikh"]
    assert [search.axis_points(Config(1, n_func_evals=b, n_grid=99), a) for b, a in ((125, 3), (64, 3), (27, 3), (20, 4))] == [4, 3, 3, 2]
    row = plans.training_summary(spark, m).first()
    table = plans.search_table(spark, m)
    assert table.columns == ["eval", "rho", "sigma_in", "leak_rate", "tikh", "loss", "n_folds", "is_grid"] and table.count() == 6
    assert table.orderBy("loss").first().rho == pytest.approx(m.cfg.rho)
    weights_ = {(r.unit, r.dim): r.weight for r in plans.readout_table(spark, m).collect()}
    assert len(weights_) == 13 * 2 and weights_[12, 1] == m.w_out[12, 1]
    assert row.n_evals == 6 and row.n_folds == best["n_folds"] == 4 and row.n_folds_asked == 2 and row.loss == pytest.approx(best["loss"])
    with pytest.raises(RuntimeError):
        plans.training_summary(spark, plans.untrained(cfg))


def test_parametric_models_search_their_scaling(spark):
    s = series(spark, [60, 70, 65], 2, p=[0.0, 1.0, 2.0])
    cfg = Config(2, n_param=1, n_units=10, n_wash=5, upsample=1, t_val=8.0, n_folds=2, n_func_evals=3, n_grid=1, noise=0.0, optimize=())
    assert cfg.searched() == ["param_shift_0", "param_norm_0"]
    m = plans.fit(s, cfg)
    assert m.norm[2] == pytest.approx(best_of(m.trace)["param_norm_0"]) and len(m.trace) == 3


def best_of(trace):
    return min(trace, key=lambda x: x["loss"])


def test_seed_ensemble_keeps_the_best(spark):
    s = series(spark, [60, 70, 65], 1)
    cfg = Config(1, n_units=10, n_wash=5, upsample=1, t_val=8.0, n_folds=2, optimize=("tikh",), tikh_range=(1e-3, 1e-1), noise=0.0, seed=3)
    m, scores = ensemble.fit_seeds(s, cfg, 3)
    rows = {r.seed: r.score for r in scores.collect()}
    assert set(rows) == {3, 4, 5} and m.cfg.seed == min(rows, key=rows.get)
    again, same = ensemble.fit_seeds(s, cfg, 3, at_once=1)
    assert again.cfg == m.cfg and {r.seed: r.score for r in same.collect()} == pytest.approx(rows)
    assert ensemble.seed_statistics(scores).first().kept_seed == m.cfg.seed


def test_snapshot_forecasts_alike(spark, tmp_path):
    s = series(spark, [120, 100], 3)
    cfg = Config(3, n_units=20, n_wash=10, upsample=1, t_val=10.0, observed_idx=(0, 2), optimize=(), tikh=1e-4, noise=0.0)
    m = plans.fit(s, cfg)
    store.save(spark, m, f"file://{tmp_path}/m")
    again = store.load(spark, f"file://{tmp_path}/m")
    starts = spark.createDataFrame([(0, 0), (1, 30)], "seg_id long, i0 long")
    a, b = (by_segment(plans.forecast_windows(x, s, starts, 8).withColumnRenamed("row_t", "t"), "yhat") for x in (m, again))
    assert all((a[k] == b[k]).all() for k in a) and again.cfg == m.cfg
    store.save(spark, plans.untrained(cfg), f"file://{tmp_path}/u")
    assert not store.load(spark, f"file://{tmp_path}/u").trained


def test_forecast_rows_are_aligned(spark):
    s = series(spark, [60], 2)
    m = plans.fit(s, Config(2, n_units=15, n_wash=5, upsample=1, t_val=10.0, optimize=(), tikh=1e-4, noise=0.0, t_test=0.0))
    got = plans.forecast_windows(m, s, spark.createDataFrame([(0, 10)], "seg_id long, i0 long"), 4).orderBy("step").collect()
    y = by_segment(s, "y")[0]
    r = plain_states(m.reservoir(), y[10:15])[-1][None]
    want = recurrence.closed_loop(m.reservoir(), m.w_out, r, 4, [0, 1])[0]
    assert [x.row_t for x in got] == [16, 17, 18, 19]  # forecast i belongs to the row start + wash-out + 1 + i
    assert np.allclose([x.yhat for x in got], want) and np.allclose([x.y for x in got], y[16:20])


def test_metrics_and_penalties(spark):
    rows = [("same", [1.0], [1.0], [2.0]), ("inf", [1.0], [float("inf")], [2.0]), ("half", [1.0], [2.0], [2.0]), ("flat", [1.0], [2.0], [0.0])]
    df = spark.createDataFrame(rows, "k string, y array<double>, yhat array<double>, norm array<double>").groupBy("k")
    y, yhat, norm = F.col("y"), F.col("yhat"), F.col("norm")
    got = {r.k: r for r in df.agg(metrics.log_nmae(y, yhat, norm).alias("log"), metrics.nmse(y, yhat).alias("sq")).collect()}
    assert got["same"].log == 10 and got["inf"].log == 10 and got["flat"].log == 10 and got["half"].log == pytest.approx(np.log10(0.5))
    assert got["inf"].sq == 1e6 and got["half"].sq == pytest.approx(1.0)
    with pytest.warns(DeprecationWarning):
        metrics.nrmse(y, yhat, norm)
    with pytest.raises(ValueError):
        metrics.metric("unknown")


def test_statistics_guard_and_methods(spark):
    s = frames.observe(series(spark, [50, 50], 2), [0, 1]).withColumn("u", F.concat("u", F.array(F.lit(3.0))))
    assert {r.dim: r.norm for r in stats.norm_stats(s, "range").collect()}[2] == 1.0
    with pytest.raises(ValueError):
        stats.norm_stats(s, "unknown")


def test_configuration_rejects_what_it_does_not_know():
    with pytest.raises(TypeError):
        Config(1, n_unit=3)
    with pytest.raises(ValueError):
        Config(1, mode="other")
    with pytest.raises(ValueError):
        Config(1).n_train


def test_chaos_is_learnt(spark):
    s = chaos.lorenz(spark, 2, 1500, transient=200)
    cfg = Config(3, dt=0.02, n_units=100, n_wash=50, upsample=1, t_val=1.0, t_test=0.0, optimize=(), rho=0.4, sigma_in=1.0, tikh=1e-8, noise=0.0)
    m = plans.fit(s, cfg)
    starts = spark.createDataFrame([(0, 300), (1, 700)], "seg_id long, i0 long")
    assert all(r.log_nmae < -2 for r in plans.run_test(m, s, starts, 25).collect())


def test_stream_gives_the_batch_forecasts(spark, tmp_path):
    from rcspark.streaming.step import stream_forecast

    s = frames.observe(series(spark, [20, 15], 1), [0])
    m = plans.fit(series(spark, [80, 70], 1), Config(1, n_units=8, n_wash=5, upsample=1, t_val=5.0, optimize=(), tikh=1e-3, noise=0.0))
    rows = s.select("seg_id", "t", "u")
    for k, part in enumerate((rows.filter("t < 9"), rows.filter("t >= 9"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    src = f"{tmp_path}/in"
    import shutil

    shutil.copytree(f"{src}0", src)
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(src)
    q = stream_forecast(stream, m).writeStream.format("memory").queryName("forecasts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    shutil.copytree(f"{src}1", f"{src}/more")
    q.processAllAvailable()
    q.stop()
    got = by_segment(spark.table("forecasts"), "yhat")
    want = by_segment(plans.readout(recurrence.states(s, m.reservoir(), 1, 0), m.w_out, m.cfg.bias_out), "yhat")
    assert all(np.allclose(got[k], want[k]) for k in want) and set(got) == set(want)
