"""Ensembles over seeds, and their reports as aggregates over a member table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from . import model as m


def fit_seeds(series: DataFrame, cfg: Config, n_seeds: int, strategy: str | Callable = "recycle", at_once: int = 4, add_noise: bool = True, **kw) -> tuple[m.Model, DataFrame]:
    """The best of ``n_seeds`` models from consecutive seeds, and (seed, score, log10_score). ``at_once`` seeds run
    side by side: each one's jobs are distributed, and the cores that one leaves idle between its searches' steps serve
    another. Without a search the score is one validation with the configured ridge candidates. NaN scores are never
    best."""
    from .search import evaluate

    def one(seed: int) -> tuple[float, int, m.Model]:
        model = m.fit(series, cfg.with_(seed=seed), strategy, add_noise, **kw)
        if model.trace:
            losses = [x["loss"] for x in model.trace if x["loss"] == x["loss"]]
            return min(losses, default=float("nan")), seed, model
        data = m.prepare(series, cfg.with_(seed=seed), add_noise)
        probe = m.Model(model.cfg.with_(optimize=("tikh",)), model.w_in, model.w, None, model.norm, model.shift)
        return evaluate(probe, data.train, strategy, [], [[]])[0][0], seed, model

    with ThreadPoolExecutor(max(1, min(at_once, n_seeds))) as pool:
        found = list(pool.map(inheritable_thread_target(series.sparkSession)(one), range(cfg.seed, cfg.seed + n_seeds)))
    scores = series.sparkSession.createDataFrame([(s, float(x)) for x, s, _ in found], "seed long, score double")
    scores = scores.withColumn("log10_score", F.when(F.col("score") > 0, F.log10("score")))
    valid = [f for f in found if f[0] == f[0]]
    return min(valid or found, key=lambda f: (f[0], f[1]))[2], scores


def seed_statistics(scores: DataFrame) -> DataFrame:
    """One row: mean, population spread, best and worst score, and the kept seed, the first on ties."""
    s = scores.filter(~F.isnan("score"))
    kept = F.min(F.struct("score", "seed"))["seed"]
    return s.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("best"), F.max("score").alias("worst"), kept.alias("kept_seed"))


def average_rank(x: str, by: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(x))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(members: DataFrame, by: list[str], x: str = "m_val", y: str = "m_test") -> DataFrame:
    ranked = members.withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("r_s"))


def selection(members: DataFrame, by: list[str]) -> DataFrame:
    """The member with the lowest validation error against its ensemble: test errors and horizons, medians, and the
    share of members with strictly lower test error."""
    kept = members.groupBy(*by).agg(F.min(F.struct("m_val", "seed", "m_test", "horizon")).alias("k")).select(*by, F.col("k.seed").alias("seed"), F.col("k.m_test").alias("kept_m_test"), F.col("k.horizon").alias("kept_horizon"))
    both = members.drop("seed").join(kept, by)
    return both.groupBy(*by).agg(
        F.first("seed").alias("seed"), F.log10(F.first("kept_m_test")).alias("log_m_test"), F.log10(F.median("m_test")).alias("log_median"),
        (100 * F.avg((F.col("m_test") < F.col("kept_m_test")).cast("double"))).alias("beaten_by"), F.first("kept_horizon").alias("horizon"), F.median("horizon").alias("median_horizon"),
    )


def regression(members: DataFrame, by: list[str], x: str = "m_val", y: str = "m_test") -> DataFrame:
    return members.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def box_stats(members: DataFrame, by: list[str], x: str) -> DataFrame:
    return members.groupBy(*by).agg(F.min(x).alias("low"), F.percentile(x, 0.25).alias("q1"), F.median(x).alias("q2"), F.percentile(x, 0.75).alias("q3"), F.max(x).alias("high"))


def horizon(errors: DataFrame, by: list[str], threshold: float, steps: int, add_one: bool = True) -> DataFrame:
    """(by, horizon) in steps: the first step whose relative error exceeds the threshold, plus one; else ``steps``.
    ``errors``: by, step, rel."""
    first = F.min(F.when(F.col("rel") > threshold, F.col("step"))) + int(add_one)
    return errors.groupBy(*by).agg(F.coalesce(first, F.lit(steps)).cast("long").alias("horizon"))


def histogram(values: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """(by, bin, density) of equal bins over the range of each group; the last bin is closed."""
    ends = values.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))
    bin_ = F.least(F.lit(bins), F.width_bucket(F.col(column), F.col("lo"), F.col("hi"), F.lit(bins).cast("long"))).cast("long")
    counted = values.join(ends, by).filter("hi > lo").groupBy(*by, bin_.alias("bin")).agg((F.count(F.lit(1)) / (F.first("n") * (F.first("hi") - F.first("lo")) / bins)).alias("density"))
    return counted


def running_best(trace: DataFrame, order: str = "eval", loss: str = "loss") -> DataFrame:
    """Adds ``best``, the lowest loss so far; a trace is as long as its search."""
    return trace.withColumn("best", F.min(loss).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
