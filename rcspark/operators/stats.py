"""Input statistics: shift and norm per dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("range", "std", "max", "mean", None)
SMALLEST = 1e-12


def _norm(method: str) -> Column:
    if method == "range":
        return F.max("x") - F.min("x")
    if method == "std":
        return F.stddev_pop("x")
    return F.max("x") - F.avg("x")  # max: signed


def norm_stats(series: DataFrame, method: str | None = "range", pooled: bool = False, column: str = "u") -> DataFrame:
    """(dim, shift, norm) of the rows' inputs.

    ``pooled``: over all rows; else over each segment's rows, and then the mean over segments. A norm of nearly 0
    becomes 1. Method None: 0 and 1.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}")
    rows = series.select("seg_id", F.posexplode(column).alias("dim", "x"))
    keys = ["dim"] if pooled else ["seg_id", "dim"]
    if method is None:
        return rows.select("dim").distinct().select("dim", F.lit(0.0).alias("shift"), F.lit(1.0).alias("norm"))
    if method == "mean":  # a second pass over the data, with each group's mean
        means = rows.groupBy(*keys).agg(F.avg("x").alias("m"))
        rows = rows.join(means, keys)
        by = rows.groupBy(*keys).agg(F.first("m").alias("shift"), F.avg(F.abs(F.col("x") - F.col("m"))).alias("norm"))
    else:
        by = rows.groupBy(*keys).agg(F.avg("x").alias("shift"), _norm(method).alias("norm"))
    if not pooled:
        by = by.groupBy("dim").agg(F.avg("shift").alias("shift"), F.avg("norm").alias("norm"))
    return by.select("dim", "shift", F.when(F.abs("norm") < SMALLEST, F.lit(1.0)).otherwise(F.col("norm")).alias("norm"))


def stats_vectors(stats: DataFrame, n_in: int, n_param: int = 0) -> tuple[list[float], list[float]]:
    """(norm, shift) lists of the inputs; parameters have norm 1 and shift 0. Bounded by the number of dimensions."""
    norm, shift = [1.0] * n_in, [0.0] * n_in
    for r in stats.filter(F.col("dim") < n_in - n_param).collect():
        norm[r.dim], shift[r.dim] = r.norm, r.shift
    return norm, shift


def normalize(u: Column, norm: list[float], shift: list[float]) -> Column:
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(n)).alias("n")) for s, n in zip(shift, norm, strict=True)])
    return F.zip_with(u, pairs, lambda x, z: (x - z["s"]) / z["n"])


def with_bias(v: Column, bias: float) -> Column:
    return F.concat(v, F.array(F.lit(float(bias))))


def param_ranges(params: DataFrame) -> DataFrame:
    """One row: the search ranges of parameter shifts and norms, over all parameters together."""
    x = params.select(F.explode("p").alias("x")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    half = F.greatest((F.col("hi") - F.col("lo")) / 2, F.lit(1e-6))
    return x.select(F.col("lo").alias("shift_lo"), F.col("hi").alias("shift_hi"), (half / 3).alias("norm_lo"), (half * 3).alias("norm_hi"))
