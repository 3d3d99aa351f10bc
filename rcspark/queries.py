"""The query catalogue: each operator on the driver's tables, and the same in DuckDB SQL.

Reservoirs of one or two units with formula weights keep the SQL small; closed loops are short, as chaos amplifies the
last digit. Values are rounded on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .config import Config
from .functions import metrics
from .functions.vectors import dims
from .operators import folds, frames, jacobian, recurrence, ridge, stats, weights
from .plans import ensemble, members as member_plans, model as plans, search
from .sources import chaos, series as src, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---- shared SQL

EV = "ev AS (SELECT user_id::BIGINT AS seg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS y FROM events)"
LD = """days AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS x, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1),
ld AS (SELECT 0::BIGINT AS seg_id, row_number() OVER (ORDER BY day) - 1 AS t, q, x, d FROM days)"""
RD = """rdays AS (SELECT n_regionkey AS reg, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
rd AS (SELECT reg::BIGINT AS seg_id, row_number() OVER (PARTITION BY reg ORDER BY day) - 1 AS t, n, x, reg::DOUBLE AS p0, (dayofweek(day) + 1)::DOUBLE AS p1 FROM rdays)"""


def query(sql: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    """Rounded; minus zero becomes zero."""
    return F.round(c, digits) + F.lit(0.0)


def flat(df, column: str, names: list[str], digits: int = 6):
    return df.select(*[c for c in df.columns if c != column], *[r6(F.get(F.col(column), F.lit(i)), digits).alias(n) for i, n in enumerate(names)])


# ---- formatting


@query(f"WITH {EV} SELECT seg_id, t // 5 AS t, y FROM ev WHERE t % 5 = 0")
def stride_series(spark, sf_dir):
    return flat(frames.stride(src.user_events(spark, sf_dir), 5), "y", ["y"], 9)


@query(f"WITH {LD} SELECT seg_id, t, q AS u0, d AS u1 FROM ld")
def observed_projection(spark, sf_dir):
    return flat(frames.observe(src.daily_lineitem(spark, sf_dir), [0, 2]).drop("y"), "u", ["u0", "u1"])


@query(f"WITH {RD} SELECT seg_id, t, n AS u0, x AS u1, p0 AS u2 FROM rd")
def append_segment_params(spark, sf_dir):
    s = frames.observe(src.region_orders(spark, sf_dir), [0, 1]).select("seg_id", "t", "y", "u")
    params = s.select("seg_id").distinct().select("seg_id", F.array(F.col("seg_id").cast("double")).alias("p"))
    return flat(frames.append_segment_params(s, params).drop("y"), "u", ["u0", "u1", "u2"])


@query(f"WITH {RD} SELECT seg_id, t // 2 AS t, n AS u0, p0 AS u1, p1 AS u2 FROM rd WHERE t % 2 = 0")
def append_step_params(spark, sf_dir):
    s = frames.observe(frames.stride(src.region_orders(spark, sf_dir), 2), [0])
    return flat(frames.append_row_params(s).drop("y", "p"), "u", ["u0", "u1", "u2"])


@query(f"WITH {EV} SELECT seg_id, 0 AS dim, round(0.01 * CASE WHEN min(y) = max(y) THEN 0 ELSE stddev_pop(y) END, 6) AS scale FROM ev WHERE t % 2 = 0 GROUP BY 1")
def noise_scale(spark, sf_dir):
    s = frames.observe(frames.stride(src.user_events(spark, sf_dir), 2), [0])
    return frames.noise_scale(s, 0.01, 1).withColumn("scale", r6(F.col("scale")))


@query(f"WITH {EV} SELECT a.seg_id, a.t, a.y AS u0, b.y AS y0 FROM ev a JOIN ev b ON a.seg_id = b.seg_id AND b.t = a.t + 1")
def one_step_pairs(spark, sf_dir):
    p = frames.pairs(frames.observe(src.user_events(spark, sf_dir), [0]))
    return p.select("seg_id", "t", *dims("u", 1, "u"), *dims("y", 1, "y"))


_SPLIT = f"""{LD}, w AS (SELECT n, greatest(22, round_even(0.8 * n, 0)::BIGINT) AS n_wtv FROM (SELECT count(*) AS n FROM ld)),
w2 AS (SELECT n, n_wtv, greatest(1, round_even(0.2 * n_wtv, 0)::BIGINT) AS n_val FROM w)"""


@query(f"""WITH {_SPLIT} SELECT CASE WHEN a.t < n_wtv - 1 THEN 'train' ELSE 'test' END AS role, a.t, a.q AS u0, b.q AS y0
FROM ld a JOIN ld b ON b.t = a.t + 1, w2 WHERE a.t <> n_wtv - 1""")
def regular_split(spark, sf_dir):
    s = frames.observe(src.daily_lineitem(spark, sf_dir), [0])
    n = s.count()
    out = frames.regular_split(s, frames.regular_windows(n, 20))
    return out.select("role", "t", *dims("u", 1, "u"), *dims("y", 1, "y"))


@query(f"WITH {_SPLIT} SELECT 'regular' AS mode, 1::BIGINT AS n_segments, n AS n_steps, greatest(1, n_wtv - n_val) AS n_train, n_val, greatest(n - greatest(1, n_wtv - n_val) - n_val - 1, 0) AS n_test FROM w2")
def regular_split_summary(spark, sf_dir):
    cfg = Config(3, mode="regular", upsample=1, n_wash=20, noise=0.0)
    return spark.createDataFrame([plans.prepare(src.daily_lineitem(spark, sf_dir), cfg).summary]).select("mode", "n_segments", "n_steps", "n_train", "n_val", "n_test")


_ROLES = f"""{EV}, len AS (SELECT seg_id, count(*) AS n FROM ev GROUP BY 1),
usable AS (SELECT *, dense_rank() OVER (ORDER BY seg_id) AS k, count(*) OVER () AS m FROM len WHERE n >= 62),
roles AS (SELECT seg_id, n, CASE WHEN k <= greatest(1, round_even(0.8 * m, 0)) THEN 'train' ELSE 'test' END AS role FROM usable)"""


@query(f"WITH {_ROLES} SELECT seg_id, role, n - 1 AS n_pairs FROM roles")
def ragged_split(spark, sf_dir):
    s = frames.observe(src.user_events(spark, sf_dir), [0])
    return frames.ragged_split(s, 60).groupBy("seg_id", "role").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(f"""WITH {_ROLES} SELECT (SELECT count(*) FROM len) AS n_segments, (SELECT count(*) FROM len WHERE n < 62) AS n_dropped,
count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, (sum(n - 61) FILTER (role = 'train'))::BIGINT AS kept_pairs,
greatest(1, trunc(median(n))::BIGINT - 61) AS n_val FROM roles""")
def ragged_split_summary(spark, sf_dir):
    return frames.split_summary(frames.segment_lengths(src.user_events(spark, sf_dir)), 60)


# ---- statistics

_NORM = {
    "range": "max({c}) - min({c})", "std": "stddev_pop({c})", "max": "max({c}) - avg({c})", "mean": "avg(abs({c} - m{c}))",
}


def _norm_sql(method: str) -> str:
    def one(dim: int, c: str) -> str:
        inner = f"(SELECT seg_id, avg({c}) AS s, {_NORM[method].format(c=c)} AS z FROM h GROUP BY seg_id)"
        return f"SELECT {dim} AS dim, round(avg(s), 4) AS shift, round(CASE WHEN abs(avg(z)) < 1e-12 THEN 1 ELSE avg(z) END, 4) AS norm FROM {inner}"

    return f"WITH {RD}, h AS (SELECT *, avg(n) OVER (PARTITION BY seg_id) AS mn, avg(x) OVER (PARTITION BY seg_id) AS mx FROM rd) {one(0, 'n')} UNION ALL {one(1, 'x')}"


def _norm_query(method: str):
    def run(spark, sf_dir):
        s = frames.observe(src.region_orders(spark, sf_dir), [0, 1])
        out = stats.norm_stats(s, method)
        return out.select("dim", r6(F.col("shift"), 4).alias("shift"), r6(F.col("norm"), 4).alias("norm"))

    return run


for _m, _name in (("range", "norm_range"), ("std", "norm_std"), ("max", "norm_max"), ("mean", "norm_mean_abs")):
    QUERIES[_name], ORACLES[_name] = _norm_query(_m), _norm_sql(_m)


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.0, 1.0)) AS v(dim, shift, norm)")
def norm_none(spark, sf_dir):
    return stats.norm_stats(frames.observe(src.region_orders(spark, sf_dir), [0, 1]), None)


@query(f"WITH {_ROLES} SELECT 0 AS dim, round(avg(y), 6) AS shift, round(max(y) - min(y), 6) AS norm FROM ev JOIN roles USING (seg_id) WHERE role = 'train' AND t < n - 1")
def norm_pooled(spark, sf_dir):
    train = frames.ragged_split(frames.observe(src.user_events(spark, sf_dir), [0]), 60).filter("role = 'train'")
    out = stats.norm_stats(train, "range", pooled=True)
    return out.select("dim", r6(F.col("shift")).alias("shift"), r6(F.col("norm")).alias("norm"))


@query(f"""WITH {RD}, x AS (SELECT min(least(p0, p1)) AS lo, max(greatest(p0, p1)) AS hi FROM rd)
SELECT lo AS shift_lo, hi AS shift_hi, round(greatest((hi - lo) / 2, 1e-6) / 3, 9) AS norm_lo, round(greatest((hi - lo) / 2, 1e-6) * 3, 9) AS norm_hi FROM x""")
def param_ranges(spark, sf_dir):
    out = stats.param_ranges(src.region_orders(spark, sf_dir))
    return out.select("shift_lo", "shift_hi", r6(F.col("norm_lo"), 9).alias("norm_lo"), r6(F.col("norm_hi"), 9).alias("norm_hi"))


@query(f"""WITH {RD}, g AS (SELECT avg(s0) AS s0, avg(z0) AS z0, avg(s1) AS s1, avg(z1) AS z1 FROM
(SELECT avg(n) AS s0, max(n) - min(n) AS z0, avg(x) AS s1, max(x) - min(x) AS z1 FROM rd GROUP BY seg_id))
SELECT seg_id, t, round((n - s0) / z0, 6) AS v0, round((x - s1) / z1, 6) AS v1, 0.1::DOUBLE AS b FROM rd, g""")
def normalized_inputs(spark, sf_dir):
    s = frames.observe(src.region_orders(spark, sf_dir), [0, 1])
    norm, shift = stats.stats_vectors(stats.norm_stats(s), 2)
    v = s.select("seg_id", "t", stats.with_bias(stats.normalize(F.col("u"), norm, shift), 0.1).alias("v"))
    return flat(v, "v", ["v0", "v1", "b"])


# ---- search grid and folds


@query("""WITH a AS (SELECT unnest(range(4)) AS i), g AS (SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS cand, 0.8 + a.i * 0.25 / 3 AS rho, -5 + b.i * 4.0 / 3 AS sigma_in FROM a, a b)
SELECT cand, round(rho, 9) AS rho, round(sigma_in, 9) AS sigma_in, tikh FROM g, (VALUES (1e-8::DOUBLE), (1e-10), (1e-12), (1e-16)) AS k(tikh)""")
def candidate_grid(spark, sf_dir):
    cfg = Config(1)
    out = search.grid_frame(spark, cfg).withColumn("tikh", F.explode(F.array(*map(F.lit, search.ridges(cfg)))))
    return out.select("cand", r6(F.col("rho"), 9).alias("rho"), r6(F.col("sigma_in"), 9).alias("sigma_in"), "tikh")


@query("SELECT * FROM (VALUES (20, 2, 4::BIGINT), (49, 2, 7), (27, 3, 3), (64, 3, 3), (125, 3, 4), (20, 4, 2)) AS v(budget, n_axes, points)")
def grid_sizes(spark, sf_dir):
    rows = [(b, a, search.axis_points(Config(1, n_func_evals=b, n_grid=99), a)) for b, a in ((20, 2), (49, 2), (27, 3), (64, 3), (125, 3), (20, 4))]
    return spark.createDataFrame(rows, "budget int, n_axes int, points long")


@query("SELECT * FROM (VALUES (1, 'param_shift_0'), (2, 'param_norm_0'), (3, 'param_shift_1'), (4, 'param_norm_1')) AS v(place, name)")
def parametric_search_names(spark, sf_dir):
    names = Config(2, n_param=2, optimize=()).searched()
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place int, name string")


@query(f"""WITH {EV}, s AS (SELECT seg_id, count(*) - 1 - 15 AS span FROM ev GROUP BY 1), k AS (SELECT *, least(4, span + 1) AS k FROM s WHERE span >= 0),
f AS (SELECT seg_id, unnest(range(k)) AS fold, CASE WHEN k > 1 THEN span // (k - 1) ELSE 0 END AS gap FROM k)
SELECT seg_id, fold, fold * gap AS p, fold * gap + 5 AS wash_to, fold * gap + 15 AS val_to FROM f""")
def folds_recycle(spark, sf_dir):
    lengths = frames.segment_lengths(frames.pairs(src.user_events(spark, sf_dir)))
    return folds.recycle(lengths, 5, 10, 4)


def _folds_sql(strategy: str, step: int) -> str:
    n = f"WITH {LD}, n AS (SELECT count(*) - 1 - 20 AS n, 150 AS v, {step} AS s FROM ld), "
    if strategy == "single_shot":
        return n + "k AS (SELECT 1) SELECT 0::BIGINT AS fold, 0::BIGINT AS train_from, n - v AS train_to, n - v AS val_from, n AS val_to FROM n"
    if strategy == "walk_forward":
        return n + """k AS (SELECT *, least(6, 1 + (n - 1 - v) // s) AS k FROM n), f AS (SELECT *, n - (k - 1) * s - v AS m, unnest(range(k)) AS fold FROM k)
SELECT fold, fold * s AS train_from, fold * s + m AS train_to, fold * s + m AS val_from, fold * s + m + v AS val_to FROM f"""
    return n + """k AS (SELECT *, least(6, 1 + (n - v) // s) AS k FROM n), f AS (SELECT *, n - (k - 1) * s - v AS o, unnest(range(k)) AS fold FROM k)
SELECT fold, 0::BIGINT AS train_from, n AS train_to, o + fold * s AS val_from, o + fold * s + v AS val_to FROM f"""


def _folds_query(strategy: str, step: int | None):
    def run(spark, sf_dir):
        n = src.daily_lineitem(spark, sf_dir).count() - 1 - 20
        return folds.single_series(spark, strategy, n, 150, 6, step)

    return run


for _s, _step, _name in (("single_shot", None, "folds_single_shot"), ("walk_forward", None, "folds_walk_forward"), ("kfold", None, "folds_kfold"), ("walk_forward", 40, "folds_walk_forward_chaotic"), ("kfold", 40, "folds_kfold_chaotic")):
    QUERIES[_name], ORACLES[_name] = _folds_query(_s, _step), _folds_sql(_s, _step or 150)


@query("""SELECT * FROM (VALUES ('short', 1::BIGINT, 3::BIGINT, 7::BIGINT, 3::BIGINT, 9::BIGINT, 9::BIGINT, 109::BIGINT), ('long', 1, 3, 13, 3, 17, 17, 220))
AS v(dataset, single_shot, walk_forward, walk_forward_chaotic, kfold, kfold_chaotic, recycle_chaotic, "window")""")
def fold_planner_goldens(spark, sf_dir):
    lt = int(round(chaos.LYAPUNOV_TIME / 0.02))
    rows = []
    for name, wash, train, val in (("short", 1, 9, 3), ("long", 2, 18, 6)):
        steps = [int(round(x * chaos.LYAPUNOV_TIME / 0.02)) for x in (wash, train, val)]
        rows.append({"dataset": name, **folds.plan_counts(*steps, lt, 1000)})
    return spark.createDataFrame(rows).select("dataset", "single_shot", "walk_forward", "walk_forward_chaotic", "kfold", "kfold_chaotic", "recycle_chaotic", "window")


# ---- small reservoirs: SIGMA (W_in [(y - SHIFT) / NORM; B]) + RHO W r

SIGMA, RHO, NORM, SHIFT, B_IN, B_OUT, WASH = 0.5, 0.8, 100.0, 0.0, 0.1, 1.0, 5


def small(n: int, leak: float = 1.0, norm: float = NORM, shift: float = SHIFT) -> plans.Model:
    w_in, w = weights.formula_matrices(n, 1)
    cfg = Config(1, n_units=n, upsample=1, n_wash=WASH, noise=0.0, rho=RHO, sigma_in=SIGMA, leak_rate=leak, optimize=(), tikh=1e-6)
    return plans.Model(cfg, w_in, w, None, np.array([norm]), np.array([shift]))


def states_sql(n: int, source: str, leak: float = 1.0, norm: float = NORM, shift: float = SHIFT, name: str = "st", param: bool = False) -> str:
    """A recursive table (seg_id, t, r0, ...) of the states after each row of ``source`` (seg_id, t, y[, p])."""
    w_in, w = weights.formula_matrices(n, 1 + param)

    def new(i: int, r: list[str], y: str) -> str:
        more = f" + {float(w_in[i, 1])!r} * {y[:-1]}p" if param else ""
        inner = f"{SIGMA} * ({float(w_in[i, 0])!r} * (({y} - {shift}) / {norm}){more} + {float(w_in[i, -1])!r} * {B_IN})"
        x = f"tanh({inner} + {RHO} * (" + " + ".join(f"{float(w[i, j])!r} * {r[j]}" for j in range(n)) + "))"
        return x if leak == 1.0 else f"({1 - leak} * {r[i]} + {leak} * {x})"

    zero = ["0.0::DOUBLE"] * n
    first = ", ".join(f"{new(i, zero, 'y')} AS r{i}" for i in range(n))
    then = ", ".join(new(i, [f"{name}.r{j}" for j in range(n)], "e.y") for i in range(n))
    return f"{name} AS (SELECT seg_id, t, {first} FROM {source} WHERE t = 0 UNION ALL SELECT e.seg_id, e.t, {then} FROM {name} JOIN {source} e ON e.seg_id = {name}.seg_id AND e.t = {name}.t + 1)"


def _event_pairs(spark, sf_dir):
    return frames.pairs(frames.observe(src.user_events(spark, sf_dir), [0]))


@query(f"WITH RECURSIVE {EV}, {states_sql(2, 'ev')} SELECT seg_id, t, round(r0, 8) + 0.0 AS r0, round(r1, 8) + 0.0 AS r1 FROM st WHERE t >= {WASH}")
def reservoir_states(spark, sf_dir):
    s = frames.observe(src.user_events(spark, sf_dir), [0])
    return flat(recurrence.states(s, small(2).reservoir(), 1, WASH), "r", ["r0", "r1"], 8)


@query(f"WITH RECURSIVE {EV}, {states_sql(2, 'ev', 0.6)} SELECT seg_id, t, round(r0, 8) + 0.0 AS r0, round(r1, 8) + 0.0 AS r1 FROM st WHERE t >= {WASH}")
def leaky_states(spark, sf_dir):
    s = frames.observe(src.user_events(spark, sf_dir), [0])
    return flat(recurrence.states(s, small(2, 0.6).reservoir(), 1, WASH), "r", ["r0", "r1"], 8)


@query(ORACLES["leaky_states"])
def native_leaky_states(spark, sf_dir):
    s = frames.observe(src.user_events(spark, sf_dir), [0])
    return flat(recurrence.native_states(s, small(2, 0.6).reservoir(), WASH), "r", ["r0", "r1"], 8)


_CELLS = "c AS (SELECT * FROM (VALUES (0), (1), (2)) AS i(i), (VALUES (0), (1), (2), (3)) AS j(j))"
_AUG = f"""a AS (SELECT st.seg_id, st.t, [r0, r1, {B_OUT}] AS l, [r0, r1, {B_OUT}, n.y / 100] AS w FROM st JOIN ev n ON n.seg_id = st.seg_id AND n.t = st.t + 1 WHERE st.t >= {WASH})"""


@query(f"WITH RECURSIVE {EV}, {states_sql(2, 'ev')}, {_AUG}, {_CELLS} SELECT i, j, round(sum(l[i + 1] * w[j + 1]), 6) + 0.0 AS v FROM a, c GROUP BY 1, 2")
def gram_terms(spark, sf_dir):
    p = _event_pairs(spark, sf_dir).withColumn("y", F.transform("y", lambda x: x / 100))
    out = ridge.gram(p, small(2).reservoir(), 1, 1, WASH)
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6(F.col("v")).alias("v"))


#: Daily mean discounts, one dimension, brought to about (-1, 1).
D_NORM, D_SHIFT, D_WASH, D_VAL, D_PART = 0.05, 0.05, 20, 6, 500
DD = f"{LD}, dd AS (SELECT seg_id, t, d AS y FROM ld)"


def daily_discount(spark, sf_dir):
    return src.daily_lineitem(spark, sf_dir).withColumn("y", F.slice("y", 3, 1))


def _daily_pairs(spark, sf_dir):
    return frames.pairs(frames.observe(daily_discount(spark, sf_dir), [0]))


_DAY1 = f"{DD}, {states_sql(1, 'dd', norm=D_NORM, shift=D_SHIFT)}, a AS (SELECT st.t - {D_WASH} AS k, r0, n.y FROM st JOIN dd n ON n.t = st.t + 1 WHERE st.t >= {D_WASH})"
_TERMS = f"sum(r0 * r0) AS a00, sum(r0 * {B_OUT}) AS a01, sum({B_OUT} * {B_OUT}) AS a11, sum(r0 * y) AS b0, sum({B_OUT} * y) AS b1"


def _daily_gram(spark, sf_dir):
    p = _daily_pairs(spark, sf_dir).withColumn("part", F.greatest(F.lit(0), F.floor((F.col("t") - D_WASH) / D_PART)).cast("long"))
    return ridge.gram(p, small(1, norm=D_NORM, shift=D_SHIFT).reservoir(), 1, 1, D_WASH, part="part")


def _cells(df):
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    return df.groupBy("part").agg(*[r6(at(i, j)).alias(n) for n, i, j in (("a00", 0, 0), ("a01", 0, 1), ("a11", 1, 1), ("b0", 0, 2), ("b1", 1, 2))])


@query(f"""WITH RECURSIVE {_DAY1}, g AS (SELECT (k // {D_PART})::BIGINT AS part, {_TERMS} FROM a GROUP BY 1)
SELECT part, {', '.join(f'round(sum({c}) OVER (ORDER BY part), 6) AS {c}' for c in ('a00', 'a01', 'a11', 'b0', 'b1'))} FROM g""")
def gram_prefix(spark, sf_dir):
    from pyspark.sql.window import Window

    upto = Window.partitionBy("i", "j").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return _cells(_daily_gram(spark, sf_dir).withColumn("v", F.sum("v").over(upto)))


@query(f"""WITH RECURSIVE {_DAY1}, g AS (SELECT (k // {D_PART})::BIGINT AS part, {_TERMS} FROM a GROUP BY 1)
SELECT part, {', '.join(f'round((SELECT sum({c}) FROM g) - {c}, 6) AS {c}' for c in ('a00', 'a01', 'a11', 'b0', 'b1'))} FROM g""")
def gram_kfold(spark, sf_dir):
    from pyspark.sql.window import Window

    whole = Window.partitionBy("i", "j")
    return _cells(_daily_gram(spark, sf_dir).withColumn("v", F.sum("v").over(whole) - F.col("v")))


def _fit_sql(rows: str, tikh: str, by: str = "") -> str:
    """w0 and w1 of a one-unit readout, in closed form, from rows (r0, y)."""
    group, keys = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""(SELECT {keys}((a11 + {tikh}) * b0 - a01 * b1) / ((a00 + {tikh}) * (a11 + {tikh}) - a01 * a01) AS w0,
((a00 + {tikh}) * b1 - a01 * b0) / ((a00 + {tikh}) * (a11 + {tikh}) - a01 * a01) AS w1 FROM (SELECT {keys}{_TERMS} FROM {rows} {group}))"""


_EV1 = f"{EV}, {states_sql(1, 'ev')}, a AS (SELECT st.seg_id, st.t, st.r0, n.y FROM st JOIN ev n ON n.seg_id = st.seg_id AND n.t = st.t + 1 WHERE st.t >= {WASH})"


def _fitted(train, model: plans.Model) -> plans.Model:
    w_out = plans.fit_readout(model, train)
    return plans.Model(model.cfg, model.w_in, model.w, w_out, model.norm, model.shift)


@query(f"WITH RECURSIVE {_EV1} SELECT round(w0, 5) AS w0, round(w1, 5) AS w1 FROM {_fit_sql('a', '1e-6')}")
def ridge_fit_closed_form(spark, sf_dir):
    w = _fitted(_event_pairs(spark, sf_dir), small(1)).w_out
    return spark.createDataFrame([(float(w[0, 0]), float(w[1, 0]))], "w0 double, w1 double").select(r6(F.col("w0"), 5).alias("w0"), r6(F.col("w1"), 5).alias("w1"))


@query("SELECT 0.0::DOUBLE AS residual")
def ridge_residual(spark, sf_dir):
    """The largest entry of (A + tikh I) W - B, relative to B's."""
    model = small(2)
    sums = ridge.collect_gram(ridge.gram(_event_pairs(spark, sf_dir), model.reservoir(), 1, 1, WASH), 2, 1)[0, 0]
    w = ridge.solve(sums, model.cfg.tikh)
    rest = np.abs((sums[:, :3] + model.cfg.tikh * np.eye(3)) @ w - sums[:, 3:]).max() / np.abs(sums[:, 3:]).max()
    return spark.createDataFrame([(float(rest),)], "residual double").select(r6(F.col("residual")).alias("residual"))


@query(f"WITH RECURSIVE {_EV1}, f AS {_fit_sql('a', '1e-6')} SELECT seg_id, t, round(w0 * r0 + w1 * {B_OUT}, 5) AS yhat, y FROM a, f")
def open_loop_forecast(spark, sf_dir):
    s = src.user_events(spark, sf_dir)
    model = _fitted(_event_pairs(spark, sf_dir), small(1))
    out = plans.one_step(model, s)
    return out.select("seg_id", "t", r6(F.get("yhat", F.lit(0)), 5).alias("yhat"), F.get("y", F.lit(0)).alias("y"))


@query(f"WITH RECURSIVE {_EV1}, f AS {_fit_sql('a', '1e-6')}, n AS (SELECT seg_id, max(y) - min(y) AS g FROM ev GROUP BY 1)\n"
       f"SELECT seg_id, count(*) AS n_rows, round(avg(abs(w0 * r0 + w1 * {B_OUT} - y)) / max(g), 6) AS nmae FROM a JOIN n USING (seg_id), f GROUP BY 1")
def reservoir_user_nmae(spark, sf_dir):
    """The flagship: one readout for all users, from distributed Gram sums; one-step forecasts; errors by user."""
    s = src.user_events(spark, sf_dir)
    model = _fitted(_event_pairs(spark, sf_dir), small(1))
    ranges = s.select("seg_id", F.get("y", F.lit(0)).alias("x")).groupBy("seg_id").agg(F.array(F.max("x") - F.min("x")).alias("norm"))
    rows = plans.one_step(model, s).join(ranges, "seg_id")
    return rows.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_rows"), r6(metrics.nmae(F.col("y"), F.col("yhat"), F.col("norm"))).alias("nmae"))


def closed_sql(seeds: str, steps: int, norm: float, shift: float, keys: str, held: float | None = None) -> str:
    """A recursive table (keys, k, r, y, w0, w1): closed-loop states from ``seeds`` (keys, r, w0, w1)."""
    w_in, w = weights.formula_matrices(1, 1 if held is None else 2)
    more = "" if held is None else f" + {float(w_in[0, 1])!r} * {held}"
    u = f"((w0 * r + w1 * {B_OUT} - {shift}) / {norm})"
    new = f"tanh({SIGMA} * ({float(w_in[0, 0])!r} * {u}{more} + {float(w_in[0, -1])!r} * {B_IN}) + {RHO} * ({float(w[0, 0])!r} * r))"
    return f"""cl AS (SELECT {keys}, 0 AS k, {new} AS r, w0, w1 FROM {seeds}
UNION ALL SELECT {keys}, k + 1, {new}, w0, w1 FROM cl WHERE k + 1 < {steps})"""


@query(f"""WITH RECURSIVE {_EV1}, f AS {_fit_sql('a', '1e-6')}, win AS (SELECT seg_id, i0, row_number() OVER (PARTITION BY seg_id, i0 ORDER BY t) - 1 AS t, y
FROM ev, (VALUES (0), (10), (20)) AS i(i0) WHERE t >= i0 AND t < i0 + {WASH}),
{states_sql(1, '(SELECT seg_id * 100 + i0 AS seg_id, t, y FROM win)', name='ws')}, seeds AS (SELECT seg_id // 100 AS s, (seg_id % 100)::BIGINT AS i0, r0 AS r, w0, w1 FROM ws, f WHERE t = {WASH - 1}),
{closed_sql('seeds', 3, NORM, SHIFT, 's, i0')}
SELECT s AS seg_id, cl.i0, k::BIGINT AS step, (cl.i0 + {WASH} + 1 + k)::BIGINT AS row_t, round(w0 * r + w1 * {B_OUT}, 4) AS yhat, ev.y FROM cl JOIN ev ON ev.seg_id = s AND ev.t = cl.i0 + {WASH} + 1 + k""")
def closed_loop_forecast(spark, sf_dir):
    s = src.user_events(spark, sf_dir)
    model = _fitted(_event_pairs(spark, sf_dir), small(1))
    starts = s.select("seg_id").distinct().withColumn("i0", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 10, 20)])))
    out = plans.forecast_windows(model, s, starts, 3)
    return out.select("seg_id", "i0", "step", "row_t", r6(F.get("yhat", F.lit(0)), 4).alias("yhat"), F.get("y", F.lit(0)).alias("y"))


# ---- validation scores, one unit, two ridges

RIDGES = (1e-2, 1.0)
_RIDGE_ROWS = "(VALUES (0::BIGINT, 1e-2::DOUBLE), (1, 1.0)) AS k(tikh_idx, tikh)"


def _candidates():
    return plans.Candidates(np.array([RHO]), np.array([SIGMA]), np.array([1.0]), RIDGES)


def _scores(df):
    return df.select("cand", "tikh_idx", r6(F.col("loss"), 4).alias("loss"), "n_folds")


_LOG = "CASE WHEN m > 0 AND isfinite(m) THEN log10(m) ELSE 10 END"


def _score_recycle_sql(param: bool) -> str:
    """With a parameter p: its own of each row while washing out, the first row's of the segment (1) in closed loop."""
    rows, held = ("pv", 1.0) if param else ("ev", None)
    fit = f"(SELECT tikh_idx AS ti, w0, w1 FROM {_fit_sql('a', 'tikh', 'tikh_idx, tikh').replace('FROM a GROUP', f'FROM a, {_RIDGE_ROWS} GROUP')})"
    return f"""WITH RECURSIVE {EV}, pv AS (SELECT *, (1 - (t // 20) % 2)::DOUBLE AS p FROM ev), {states_sql(1, rows, param=param)},
a AS (SELECT st.seg_id, st.t, st.r0, n.y FROM st JOIN ev n ON n.seg_id = st.seg_id AND n.t = st.t + 1 WHERE st.t >= {WASH}),
f AS (SELECT tikh_idx, w0, w1 FROM {_RIDGE_ROWS}, {fit} z WHERE z.ti = tikh_idx),
s AS (SELECT seg_id, count(*) - 1 - {WASH} - 10 AS span, max(y) - min(y) AS whole FROM ev GROUP BY 1),
fo AS (SELECT seg_id, unnest(range(least(4, span + 1))) AS fold, CASE WHEN least(4, span + 1) > 1 THEN span // (least(4, span + 1) - 1) ELSE 0 END AS gap FROM s WHERE span >= 0),
win AS (SELECT fo.seg_id * 10 + fold AS seg_id, v.t - fold * gap AS t, y, p FROM fo JOIN pv v ON v.seg_id = fo.seg_id AND v.t >= fold * gap AND v.t < fold * gap + {WASH}),
{states_sql(1, 'win', name='ws', param=param)}, seeds AS (SELECT ws.seg_id AS q, tikh_idx, r0 AS r, w0, w1 FROM ws, f WHERE t = {WASH - 1}),
{closed_sql('seeds', 10, NORM, SHIFT, 'q, tikh_idx', held)},
g AS (SELECT seg_id, max(y) - min(y) AS g FROM ev WHERE t > 0 GROUP BY 1),
m AS (SELECT q, tikh_idx, avg(abs(w0 * r + w1 * {B_OUT} - ev.y)) / max(g.g) AS m FROM cl JOIN fo ON fo.seg_id = q // 10 AND fo.fold = q % 10 JOIN ev ON ev.seg_id = fo.seg_id AND ev.t = fold * gap + {WASH} + 1 + k JOIN g ON g.seg_id = fo.seg_id GROUP BY 1, 2)
SELECT 0::BIGINT AS cand, tikh_idx, round(avg({_LOG}), 4) AS loss, count(*) AS n_folds FROM m GROUP BY tikh_idx"""


@query(_score_recycle_sql(param=False))
def score_recycle(spark, sf_dir):
    model = small(1)
    model = plans.Model(model.cfg.with_(t_val=10.0, n_folds=4), model.w_in, model.w, None, model.norm, model.shift)
    return _scores(plans.score_recycle(model, _event_pairs(spark, sf_dir), _candidates()))


@query(_score_recycle_sql(param=True))
def score_recycle_parametric(spark, sf_dir):
    """A parameter that changes within segments."""
    w_in, w = weights.formula_matrices(1, 2)
    cfg = small(1).cfg.with_(n_param=1, t_val=10.0, n_folds=4)
    model = plans.Model(cfg, w_in, w, None, np.array([NORM, 1.0]), np.array([SHIFT, 0.0]))
    s = src.user_events(spark, sf_dir).withColumn("p", F.array((1 - F.floor(F.col("t") / 20) % 2).cast("double")))
    pairs = frames.pairs(frames.append_row_params(frames.observe(s, [0])))
    return _scores(plans.score_recycle(model, pairs, _candidates()))


def _score_series_sql(strategy: str) -> str:
    fo = _folds_sql(strategy, D_VAL * 25).split("FROM ld), ", 1)[1]
    fo = fo.replace("SELECT *, least(6", "SELECT *, least(3")
    head, tail = fo.rsplit("\nSELECT", 1) if "\nSELECT" in fo else fo.split(") SELECT", 1)
    head = head if "\nSELECT" in fo else head + ")"
    inside = "k >= train_from AND k < train_to" if strategy != "kfold" else "NOT (k >= val_from AND k < val_to)"
    fit = _fit_sql("tr", "tikh", "fold, tikh_idx, tikh")
    return f"""WITH RECURSIVE {_DAY1}, n AS (SELECT count(*) AS n, {D_VAL * 25} AS v, {D_VAL * 25} AS s FROM a), {head}, fo AS (SELECT{tail}),
tr AS (SELECT fold, tikh_idx, tikh, r0, y FROM fo JOIN a ON {inside}, {_RIDGE_ROWS}), fit AS (SELECT fold AS ff, tikh_idx, w0, w1 FROM {fit}),
seeds AS (SELECT fold, tikh_idx, st.r0 AS r, w0, w1 FROM fo JOIN fit ON ff = fold JOIN st ON st.t = val_from + {D_WASH} - 1),
{closed_sql('seeds', D_VAL * 25, D_NORM, D_SHIFT, 'fold, tikh_idx')},
m AS (SELECT cl.fold, tikh_idx, avg(abs(w0 * cl.r + w1 * {B_OUT} - a.y)) / (SELECT max(y) - min(y) FROM dd WHERE t > 0) AS m FROM cl JOIN fo ON fo.fold = cl.fold JOIN a ON a.k = val_from + cl.k GROUP BY 1, 2)
SELECT 0::BIGINT AS cand, tikh_idx, round(avg({_LOG}), 4) AS loss, count(*) AS n_folds FROM m GROUP BY tikh_idx"""


def _score_series_query(strategy: str):
    def run(spark, sf_dir):
        model = small(1, norm=D_NORM, shift=D_SHIFT)
        cfg = model.cfg.with_(t_val=float(D_VAL * 25), n_folds=3, n_wash=D_WASH)
        model = plans.Model(cfg, model.w_in, model.w, None, model.norm, model.shift)
        return _scores(plans.score_single_series(model, _daily_pairs(spark, sf_dir), _candidates(), strategy))

    return run


for _s in folds.SINGLE_SERIES:
    QUERIES[f"score_{_s}"], ORACLES[f"score_{_s}"] = _score_series_query(_s), _score_series_sql(_s)


# ---- metrics, with the row before as the forecast

_PERSIST = f"{EV}, p AS (SELECT a.seg_id, a.y AS yhat, b.y, b.t FROM ev a JOIN ev b ON b.seg_id = a.seg_id AND b.t = a.t + 1), g AS (SELECT seg_id, max(y) - min(y) AS g FROM ev GROUP BY 1)"


def _persistence(spark, sf_dir):
    s = src.user_events(spark, sf_dir)
    g = s.groupBy("seg_id").agg(F.array(F.max(F.get("y", F.lit(0))) - F.min(F.get("y", F.lit(0)))).alias("norm"))
    return frames.pairs(frames.observe(s, [0])).join(g, "seg_id")


@query(f"WITH {_PERSIST} SELECT seg_id, round(avg(abs(y - yhat)) / max(g), 6) AS nmae FROM p JOIN g USING (seg_id) GROUP BY 1")
def metric_nmae(spark, sf_dir):
    return _persistence(spark, sf_dir).groupBy("seg_id").agg(r6(metrics.nmae(F.col("y"), F.col("u"), F.col("norm"))).alias("nmae"))


@query(f"WITH {_PERSIST}, m AS (SELECT seg_id, avg(abs(y - yhat)) / max(g) AS m FROM p JOIN g USING (seg_id) GROUP BY 1) SELECT seg_id, round({_LOG}, 6) AS log_nmae FROM m")
def metric_log_nmae(spark, sf_dir):
    return _persistence(spark, sf_dir).groupBy("seg_id").agg(r6(metrics.log_nmae(F.col("y"), F.col("u"), F.col("norm"))).alias("log_nmae"))


@query(f"WITH {_PERSIST} SELECT seg_id, round(avg((y - yhat) ** 2) / (avg(y ** 2) + 1e-14), 6) AS nmse FROM p GROUP BY 1")
def metric_nmse(spark, sf_dir):
    return _persistence(spark, sf_dir).groupBy("seg_id").agg(r6(metrics.nmse(F.col("y"), F.col("u"))).alias("nmse"))


#: Windows of 40 days of the daily series; each one's first row is the forecast of all its rows.
_WINDOWS = f"""{LD}, g AS (SELECT max(q) - min(q) AS gq, max(x) - min(x) AS gx FROM ld), h AS (SELECT sqrt(avg((q / gq) ** 2 + (x / gx) ** 2)) AS h FROM ld, g),
e AS (SELECT b.t // 40 AS win, b.t % 40 AS step, (b.q - a.q) / gq AS eq, (b.x - a.x) / gx AS ex FROM ld a JOIN ld b ON a.t = b.t - b.t % 40, g)"""


def _window_errors(spark, sf_dir):
    s = src.daily_lineitem(spark, sf_dir).select("t", *dims("y", 2, "y"))
    g = s.agg(*[(F.max(f"y{i}") - F.min(f"y{i}")).alias(f"g{i}") for i in range(2)])
    first = s.filter(F.col("t") % 40 == 0).select(F.floor(F.col("t") / 40).cast("long").alias("win"), F.col("y0").alias("f0"), F.col("y1").alias("f1"))
    rows = s.withColumn("win", F.floor(F.col("t") / 40).cast("long")).join(first, "win").crossJoin(F.broadcast(g))  # one row
    h = s.crossJoin(F.broadcast(g)).agg(F.sqrt(F.avg((F.col("y0") / F.col("g0")) ** 2 + (F.col("y1") / F.col("g1")) ** 2)).alias("h"))
    rows = rows.select("win", (F.col("t") % 40).alias("step"), ((F.col("y0") - F.col("f0")) / F.col("g0")).alias("e0"), ((F.col("y1") - F.col("f1")) / F.col("g1")).alias("e1"))
    return rows.crossJoin(F.broadcast(h))  # one row


@query(f"""WITH {_WINDOWS} SELECT win, coalesce(min(step) FILTER (sqrt(eq ** 2 + ex ** 2) / h > 0.2) + 1, 40)::BIGINT AS horizon,
coalesce(min(step) FILTER (sqrt(eq ** 2 + ex ** 2) / h > 0.2), 40)::BIGINT AS horizon_exclusive FROM e, h GROUP BY 1""")
def prediction_horizon(spark, sf_dir):
    e = _window_errors(spark, sf_dir).withColumn("rel", F.sqrt(F.col("e0") ** 2 + F.col("e1") ** 2) / F.col("h"))
    one = ensemble.horizon(e, ["win"], 0.2, 40)
    return one.join(ensemble.horizon(e, ["win"], 0.2, 40, add_one=False).withColumnRenamed("horizon", "horizon_exclusive"), "win")


@query(f"WITH {_WINDOWS}, m AS (SELECT win, avg((eq ** 2 + ex ** 2) / 2) AS m FROM e WHERE step < 20 GROUP BY 1) SELECT round(pow(10, avg(log10(m))), 6) AS geomean, count(*) AS n FROM m WHERE m > 0")
def window_mse_geomean(spark, sf_dir):
    e = _window_errors(spark, sf_dir).filter("step < 20").groupBy("win").agg(F.avg((F.col("e0") ** 2 + F.col("e1") ** 2) / 2).alias("m"))
    return e.filter("m > 0").agg(r6(F.pow(F.lit(10.0), F.avg(F.log10("m")))).alias("geomean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_WINDOWS}, s AS (SELECT stddev_pop(q) AS sq, stddev_pop(x) AS sx FROM ld)
SELECT round(avg(sqrt(((eq * gq) / sq) ** 2 + ((ex * gx) / sx) ** 2) / sqrt(2)), 6) AS scaled FROM e, g, s""")
def attractor_scaled_error(spark, sf_dir):
    s = src.daily_lineitem(spark, sf_dir).select("t", *dims("y", 2, "y"))
    z = s.agg(*[F.stddev_pop(f"y{i}").alias(f"s{i}") for i in range(2)])
    first = s.filter(F.col("t") % 40 == 0).select(F.floor(F.col("t") / 40).cast("long").alias("win"), F.col("y0").alias("f0"), F.col("y1").alias("f1"))
    rows = s.withColumn("win", F.floor(F.col("t") / 40).cast("long")).join(first, "win").crossJoin(F.broadcast(z))  # one row
    d = [((F.col(f"y{i}") - F.col(f"f{i}")) / F.col(f"s{i}")) ** 2 for i in range(2)]
    return rows.agg(r6(F.avg(F.sqrt(d[0] + d[1]) / F.sqrt(F.lit(2.0)))).alias("scaled"))


@query(f"""WITH {_PERSIST}, v AS (SELECT seg_id % 5 AS grp, y - yhat AS e FROM p), r AS (SELECT grp, min(e) AS lo, max(e) AS hi, count(*) AS n FROM v GROUP BY 1)
SELECT grp, least(20, 1 + floor((e - lo) / ((hi - lo) / 20))::BIGINT) AS bin, round(count(*) / (max(n) * (max(hi) - max(lo)) / 20), 9) AS density FROM v JOIN r USING (grp) GROUP BY 1, 2""")
def error_histogram(spark, sf_dir):
    e = _persistence(spark, sf_dir).select((F.col("seg_id") % 5).alias("grp"), (F.get("y", F.lit(0)) - F.get("u", F.lit(0))).alias("e"))
    return ensemble.histogram(e, "e", 20, ["grp"]).withColumn("density", r6(F.col("density"), 9))


_TRACE = [(0, 0.9), (1, 0.7), (2, 0.8), (3, 0.7), (4, 0.2), (5, 0.5)]


@query("WITH v AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE), (1, 0.7), (2, 0.8), (3, 0.7), (4, 0.2), (5, 0.5)) AS v(eval, loss)) SELECT eval, loss, min(loss) OVER (ORDER BY eval) AS best FROM v")
def convergence_trace(spark, sf_dir):
    return ensemble.running_best(spark.createDataFrame(_TRACE, "eval int, loss double"))


# ---- member tables: an ensemble for each order priority

MB = """mb AS (SELECT o_orderpriority AS strategy, o_custkey % 24 AS seed, round(avg(o_totalprice), 0) / 1000 AS m_val, round(stddev_pop(o_totalprice) / 1000, 1) AS m_test,
  round(max(o_totalprice) / 1000, 2) AS horizon FROM orders GROUP BY 1, 2)"""


def members(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy"), (F.col("o_custkey") % 24).alias("seed"))
    return o.agg((F.round(F.avg("o_totalprice"), 0) / 1000).alias("m_val"), F.round(F.stddev_pop("o_totalprice") / 1000, 1).alias("m_test"), F.round(F.max("o_totalprice") / 1000, 2).alias("horizon"))


@query(f"WITH {MB} SELECT round(avg(m_val), 6) AS mean, round(stddev_pop(m_val), 6) AS std, min(m_val) AS best, max(m_val) AS worst, arg_min(seed, (m_val, seed)) AS kept_seed FROM mb WHERE strategy = '1-URGENT'")
def seed_selection(spark, sf_dir):
    out = ensemble.seed_statistics(members(spark, sf_dir).filter("strategy = '1-URGENT'").select("seed", F.col("m_val").alias("score")))
    return out.select(r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "best", "worst", "kept_seed")


@query(f"""WITH {MB}, r AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY m_val) + (count(*) OVER (PARTITION BY strategy, m_val) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY strategy ORDER BY m_test) + (count(*) OVER (PARTITION BY strategy, m_test) - 1) / 2.0 AS ry FROM mb) SELECT strategy, round(corr(rx, ry), 6) AS r_s FROM r GROUP BY 1""")
def spearman_val_test(spark, sf_dir):
    return ensemble.spearman(members(spark, sf_dir), ["strategy"]).withColumn("r_s", r6(F.col("r_s")))


@query(f"""WITH {MB}, k AS (SELECT strategy, arg_min(seed, (m_val, seed)) AS seed FROM mb GROUP BY 1), kk AS (SELECT mb.* FROM mb JOIN k USING (strategy, seed))
SELECT mb.strategy, max(kk.seed) AS seed, round(log10(max(kk.m_test)), 6) AS log_m_test, round(log10(median(mb.m_test)), 6) AS log_median, round(100 * avg((mb.m_test < kk.m_test)::INT), 6) AS beaten_by,
max(kk.horizon) AS horizon, round(median(mb.horizon), 6) AS median_horizon FROM mb JOIN kk USING (strategy) GROUP BY 1""")
def ensemble_selection(spark, sf_dir):
    out = ensemble.selection(members(spark, sf_dir), ["strategy"])
    return out.select("strategy", "seed", *[r6(F.col(c)).alias(c) for c in ("log_m_test", "log_median", "beaten_by")], "horizon", r6(F.col("median_horizon")).alias("median_horizon"))


@query(f"WITH {MB} SELECT strategy, round(regr_slope(m_test, m_val), 6) AS slope, round(regr_intercept(m_test, m_val), 5) AS intercept FROM mb GROUP BY 1")
def val_test_regression(spark, sf_dir):
    out = ensemble.regression(members(spark, sf_dir), ["strategy"])
    return out.select("strategy", r6(F.col("slope")).alias("slope"), r6(F.col("intercept"), 5).alias("intercept"))


@query(f"WITH {MB} SELECT strategy, min(m_test) AS low, round(quantile_cont(m_test, 0.25), 6) AS q1, round(median(m_test), 6) AS q2, round(quantile_cont(m_test, 0.75), 6) AS q3, max(m_test) AS high FROM mb GROUP BY 1")
def boxplot_stats(spark, sf_dir):
    out = ensemble.box_stats(members(spark, sf_dir), ["strategy"], "m_test")
    return out.select("strategy", "low", *[r6(F.col(c)).alias(c) for c in ("q1", "q2", "q3")], "high")


# ---- tests, Jacobian, sources, persistence


@query(f"""WITH {LD}, n AS (SELECT count(*) AS n FROM ld), w AS (SELECT n, unnest(range(0, n - 30, 100)) AS i0 FROM n)
SELECT 0::BIGINT AS seg_id, i0, i0 AS u_from, i0 + 49 AS u_to, i0 + 20 AS y_from, least(i0 + 50, n) AS y_to FROM w WHERE least(i0 + 50, n) > i0 + 20""")
def test_windows(spark, sf_dir):
    return frames.test_windows(frames.segment_lengths(src.daily_lineitem(spark, sf_dir)), 100, 30, 20)


@query(f"WITH {EV}, len AS (SELECT seg_id, count(*) AS n_steps FROM ev GROUP BY 1) SELECT seg_id, n_steps FROM len WHERE n_steps >= 60 ORDER BY seg_id LIMIT 10")
def test_segments(spark, sf_dir):
    return frames.test_segments(frames.segment_lengths(src.user_events(spark, sf_dir)), 30, Config(1).max_l_tests)


@query(f"""WITH RECURSIVE {_EV1}, f AS {_fit_sql('a', '1e-6')}, win AS (SELECT seg_id * 100 + i0 AS seg_id, t - i0 AS t, y FROM ev, (VALUES (0), (20)) AS i(i0) WHERE t >= i0 AND t < i0 + {WASH}),
{states_sql(1, 'win', name='ws')}, seeds AS (SELECT seg_id AS s, r0 AS r, w0, w1 FROM ws, f WHERE t = {WASH - 1}), {closed_sql('seeds', 3, NORM, SHIFT, 's')}, g AS (SELECT seg_id, max(y) - min(y) AS g FROM ev GROUP BY 1),
e AS (SELECT s // 100 AS seg_id, s, avg(abs(w0 * r + w1 * {B_OUT} - ev.y)) / max(g) AS m FROM cl JOIN ev ON ev.seg_id = s // 100 AND ev.t = s % 100 + {WASH} + 1 + k JOIN g ON g.seg_id = s // 100 GROUP BY 1, 2),
b AS (SELECT seg_id, avg({_LOG}) AS x FROM e GROUP BY 1) SELECT round(min(x), 4) AS low, round(max(x), 4) AS high, round(avg(x), 4) AS mean, count(*) AS n_segments FROM b""")
def test_summary(spark, sf_dir):
    s = src.user_events(spark, sf_dir)
    model = _fitted(_event_pairs(spark, sf_dir), small(1))
    starts = s.select("seg_id").distinct().withColumn("i0", F.explode(F.array(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    by = plans.run_test(model, s, starts, 3).groupBy("seg_id").agg(F.avg("log_nmae").alias("x"))
    return by.agg(r6(F.min("x"), 4).alias("low"), r6(F.max("x"), 4).alias("high"), r6(F.avg("x"), 4).alias("mean"), F.count(F.lit(1)).alias("n_segments"))


def _jacobian_sql() -> str:
    w_in, _ = weights.formula_matrices(2, 1)
    # with a leak of 0.6, the value before it is (r - 0.4 r') / 0.6
    x = [f"((st.r{i} - 0.4 * p.r{i}) / 0.6)" for i in range(2)]
    terms = " + ".join(f"{wo} * 0.6 * (1 - {x[i]} ** 2) * {SIGMA} * {float(w_in[i, 0])!r} / {NORM}" for i, wo in enumerate((0.5, -0.25)))
    return f"WITH RECURSIVE {EV}, {states_sql(2, 'ev', 0.6)} SELECT st.seg_id, st.t, round({terms}, 9) + 0.0 AS j0 FROM st JOIN st p ON p.seg_id = st.seg_id AND p.t = st.t - 1 WHERE st.t >= {WASH}"


@query(_jacobian_sql())
def jacobian_open_loop(spark, sf_dir):
    s = frames.observe(src.user_events(spark, sf_dir), [0])
    out = jacobian.jacobians(s, small(2, 0.6).reservoir(), np.array([[0.5], [-0.25], [0.1]]), 1, WASH)
    return flat(out, "jac", ["j0"], 9)


def _rk4_sql() -> str:
    def rate(x: str, y: str, z: str) -> tuple[str, str, str]:
        return f"(10.0 * ({y} - {x}))", f"({x} * (28.0 - {z}) - {y})", f"({x} * {y} - (8.0::DOUBLE / 3) * {z})"

    stages, names = [], ("x", "y", "z")
    for i, (prev, h) in enumerate((("", 0), ("k1", "0.01"), ("k2", "0.01"), ("k3", "0.02"))):
        at = [f"({n} + {h} * {prev}{n})" if prev else n for n in names]
        stages.append(", ".join(f"{r} AS k{i + 1}{n}" for r, n in zip(rate(*at), names, strict=True)))
    inner = "l"
    for st in stages:
        inner = f"(SELECT *, {st} FROM {inner})"
    new = ", ".join(f"{n} + 0.02::DOUBLE / 6 * (k1{n} + 2 * k2{n} + 2 * k3{n} + k4{n})" for n in names)
    first = "SELECT unnest(range(3))::BIGINT AS seg_id, 0::BIGINT AS t, 1 + unnest(range(3)) / 10.0::DOUBLE AS x, 1.0::DOUBLE AS y, 1.0::DOUBLE AS z"
    return f"WITH RECURSIVE l AS ({first} UNION ALL SELECT seg_id, t + 1, {new} FROM {inner} WHERE t < 99) SELECT seg_id, t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM l"


@query(_rk4_sql())
def synthetic_chaos_rk4(spark, sf_dir):
    return flat(chaos.lorenz(spark, 3, 100), "y", ["x", "y", "z"])


@query(f"WITH RECURSIVE {_EV1} SELECT 1 AS n_units, true AS trained, 0.8::DOUBLE AS rho, round(w0, 5) AS w0, round(w1, 5) AS w1 FROM {_fit_sql('a', '1e-6')}")
def model_roundtrip(spark, sf_dir):
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="rcspark-model-")
    path = f"{base}/rcspark-model-{spark.sparkContext.applicationId}"
    store.save(spark, _fitted(_event_pairs(spark, sf_dir), small(1)), path)
    m = store.load(spark, path)
    row = (m.cfg.n_units, m.trained, m.cfg.rho, float(m.w_out[0, 0]), float(m.w_out[1, 0]))
    return spark.createDataFrame([row], "n_units int, trained boolean, rho double, w0 double, w1 double").select("n_units", "trained", "rho", r6(F.col("w0"), 5).alias("w0"), r6(F.col("w1"), 5).alias("w1"))


# ---- whole trainings: no SQL


def _small_search(**kw) -> Config:
    return Config(1, n_units=20, upsample=1, n_wash=5, t_val=10.0, n_folds=2, n_func_evals=6, n_grid=2, noise=1e-3, optimize=("rho", "sigma_in", "tikh"), tikh_range=(1e-4, 1e-2)).with_(**kw)


@query()
def bayes_search(spark, sf_dir):
    m = plans.fit(src.user_events(spark, sf_dir), _small_search())
    return spark.createDataFrame(m.trace)


@query()
def seed_ensemble(spark, sf_dir):
    _, scores = ensemble.fit_seeds(src.user_events(spark, sf_dir), _small_search(optimize=("tikh",)), 3)
    return ensemble.seed_statistics(scores)


@query()
def numpy_reservoir_fit(spark, sf_dir):
    s = src.user_events(spark, sf_dir)
    m = plans.fit(s, _small_search(n_units=50, optimize=(), tikh=1e-3))
    starts = s.select("seg_id").distinct().withColumn("i0", F.lit(0).cast("long"))
    return plans.run_test(m, s, starts, 10)


@query()
def parametric_fit(spark, sf_dir):
    s = src.region_orders(spark, sf_dir)
    m = plans.fit(s, Config(2, n_param=2, mode="ragged", n_units=30, upsample=1, n_wash=10, t_val=20.0, t_test=0.0, noise=0.0, optimize=(), optimize_parameter_normalization=False, sigma_in=0.1, tikh=1e-4))
    return plans.training_summary(spark, m)


@query()
def strategy_comparison(spark, sf_dir):
    """Validation against test over an ensemble on the Lorenz system, by strategy: rank correlation, and the member kept.
    Small, for the catalogue; ``members.lorenz_experiment()`` has the published size by default."""
    data, rest, cfg, strategies, tests = member_plans.lorenz_experiment(windows=8, n_units=40, n_grid=2, n_func_evals=4)
    found = member_plans.compare(spark, data, rest, cfg, strategies, list(range(1, 5)), tests).cache()
    return ensemble.spearman(found, ["strategy"]).join(ensemble.selection(found, ["strategy"]), "strategy")
