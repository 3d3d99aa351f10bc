"""Fold geometry of the validation strategies, as DataFrames of half-open row ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE_SERIES = ("single_shot", "walk_forward", "kfold")
STRATEGIES = ("recycle", *SINGLE_SERIES)


def _numbers(k: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("fold")


def recycle(lengths: DataFrame, n_wash: int, n_val: int, n_folds: int) -> DataFrame:
    """(seg_id, fold, p, wash_to, val_to): evenly spread over each segment's ``n_steps`` pairs; segments that hold no
    fold have none. Washes out on [p, wash_to) and is scored on [wash_to, val_to)."""
    span = F.col("n_steps") - n_wash - n_val
    k = F.least(F.lit(n_folds).cast("long"), span + 1)
    gap = F.when(k > 1, F.floor(span / F.greatest(k - 1, F.lit(1)))).otherwise(0).cast("long")
    rows = lengths.filter(span >= 0).select("seg_id", gap.alias("gap"), _numbers(k))
    p = F.col("fold") * F.col("gap")
    return rows.select("seg_id", "fold", p.alias("p"), (p + n_wash).alias("wash_to"), (p + n_wash + n_val).alias("val_to"))


def single_series_table(strategy: str, n: int, v: int, n_folds: int, step: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_from, train_to, val_from, val_to) of ``n`` rows after wash-out and intervals of ``v``. k-fold trains
    on what lies outside of its interval, so its train range is all rows."""
    step = v if step is None else step
    if n < v + 1:
        raise ValueError(f"{strategy}: {n} rows after wash-out can't hold an interval of {v} and a training row")
    if strategy == "single_shot":
        return [(0, 0, n - v, n - v, n)]
    if strategy == "walk_forward":
        k = min(n_folds, 1 + (n - 1 - v) // step)
        m = n - (k - 1) * step - v
        return [(f, f * step, f * step + m, f * step + m, f * step + m + v) for f in range(k)]
    if strategy == "kfold":
        k = min(n_folds, 1 + (n - v) // step)
        first = n - (k - 1) * step - v
        return [(f, 0, n, first + f * step, first + f * step + v) for f in range(k)]
    raise ValueError(f"unknown strategy {strategy!r}; single-series ones are {SINGLE_SERIES}")


def single_series(spark: SparkSession, strategy: str, n: int, v: int, n_folds: int, step: int | None = None) -> DataFrame:
    rows = single_series_table(strategy, n, v, n_folds, step)
    return spark.createDataFrame(rows, "fold long, train_from long, train_to long, val_from long, val_to long")


def train_ranges(fold: tuple[int, int, int, int, int]) -> list[tuple[int, int]]:
    """The rows that a fold trains on: its train range without its validation interval; empty ranges are left out."""
    _, a, b, i0, i1 = fold
    parts = [(a, min(b, i0)), (max(a, i1), b)]
    return [(x, y) for x, y in parts if y > x]


def plan_counts(n_wash: int, n_train: int, n_val: int, lyapunov: int, most: int) -> dict[str, int]:
    """Folds of each strategy and of its chaotic form, which advances by one Lyapunov time; the chaotic walk-forward
    keeps the regular one's window, the recycled one is spaced by about a Lyapunov time. Also the regular window."""
    n = n_train + n_val - 1 - n_wash
    k = 1 + (n - 1 - n_val) // n_val
    window = n - (k - 1) * n_val - n_val
    return {
        "single_shot": 1, "walk_forward": min(most, k), "walk_forward_chaotic": 1 + (n - window - n_val) // lyapunov,
        "kfold": min(most, 1 + (n - n_val) // n_val), "kfold_chaotic": min(most, 1 + (n - n_val) // lyapunov),
        "recycle_chaotic": (n - n_val) // lyapunov + 1, "window": window,
    }
