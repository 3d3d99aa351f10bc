"""Formatting of series: striding, projection, parameters, one-step pairs and splits, all as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import pick

#: The share of a corpus that trains, and of a training window that validates, when none is given.
TRAIN_SHARE, VAL_SHARE = 0.8, 0.2


def stride(series: DataFrame, k: int) -> DataFrame:
    """Rows 0, k, 2k, ... of each segment, renumbered. A per-row parameter follows its row."""
    if k < 1:
        raise ValueError("the stride must be at least 1")
    return series if k == 1 else series.filter(F.col("t") % k == 0).withColumn("t", F.floor(F.col("t") / k).cast("long"))


def observe(series: DataFrame, idx: Sequence[int]) -> DataFrame:
    """Adds the input ``u``, the observed dimensions of ``y``."""
    return series.withColumn("u", pick("y", idx))


def append_segment_params(series: DataFrame, params: DataFrame, small_rows: int = 100_000) -> DataFrame:
    """Appends each segment's constant parameters, from (seg_id, p), to ``u``. Segments without any are dropped."""
    small = params.limit(small_rows + 1).count() <= small_rows
    joined = series.drop("p").join(F.broadcast(params) if small else params, "seg_id")
    return joined.withColumn("u", F.concat("u", "p")).drop("p")


def append_row_params(series: DataFrame) -> DataFrame:
    """Appends the row's own parameters ``p`` to ``u``."""
    return series.withColumn("u", F.concat("u", "p"))


def noise_scale(series: DataFrame, level: float, n: int) -> DataFrame:
    """(seg_id, dim, scale): level times the population standard deviation of each input; constants get none."""
    rows = series.select("seg_id", F.posexplode("u").alias("dim", "x")) if n else series
    spread = F.when(F.min("x") == F.max("x"), F.lit(0.0)).otherwise(F.stddev_pop("x"))
    return rows.groupBy("seg_id", "dim").agg((F.lit(level) * spread).alias("scale"))


def add_noise(series: DataFrame, level: float, n_observed: int, seed: int) -> DataFrame:
    """Gaussian noise on the observed inputs, scaled by segment and dimension. The draws are a function of
    (seed, segment, t, dimension), so lost tasks repeat them."""
    if not level:
        return series
    scales = noise_scale(series, level, n_observed).filter(F.col("dim") < n_observed)
    scales = scales.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("dim", "scale"))).alias("scales"))

    def uniform(salt: int, i: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(salt), "seg_id", "t", i)
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))

    def noisy(x: Column, i: Column) -> Column:
        normal = F.sqrt(-2 * F.log(uniform(1, i))) * F.cos(F.lit(2 * 3.141592653589793) * uniform(2, i))
        return F.when(i < n_observed, x + normal * F.get(F.col("scales"), i)["scale"]).otherwise(x)

    return series.join(scales, "seg_id").withColumn("u", F.transform("u", noisy)).drop("scales")


def pairs(series: DataFrame) -> DataFrame:
    """(seg_id, t, u, y): each input with the next row's state; the last row of a segment has none."""
    following = F.lead("y").over(Window.partitionBy("seg_id").orderBy("t"))
    return series.withColumn("y", following).filter(F.col("y").isNotNull())


# ---- windows


@dataclass(frozen=True)
class Windows:
    """Resolved lengths in steps."""

    n_wash: int
    n_train: int
    n_val: int

    @property
    def n_wtv(self) -> int:
        return self.n_train + self.n_val


def regular_windows(n_steps: int, n_wash: int, n_train: int | None = None, n_val: int | None = None) -> Windows:
    """Lengths that aren't given follow from the segment's; round is half to even."""
    if n_train is None:
        n_wtv = max(n_wash + 2, round(TRAIN_SHARE * n_steps))
        n_val = max(1, round(VAL_SHARE * n_wtv)) if n_val is None else n_val
        n_train = max(1, n_wtv - n_val)
    elif n_val is None:
        n_val = max(1, round(VAL_SHARE * n_train))
    if n_steps < n_train + n_val:
        raise ValueError(f"segments have {n_steps} steps; training and validation need {n_train + n_val}")
    return Windows(n_wash, n_train, n_val)


def regular_split(series: DataFrame, w: Windows) -> DataFrame:
    """One-step pairs with their role: ``train`` (with validation) lies below n_wtv, ``test`` behind it. The pair that
    crosses the border belongs to neither."""
    crosses = F.col("t") == w.n_wtv - 1
    return pairs(series).filter(~crosses).withColumn("role", F.when(F.col("t") < w.n_wtv - 1, "train").otherwise("test"))


def segment_lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_steps"))


def ragged_roles(lengths: DataFrame, n_wash: int, t_test: float) -> DataFrame:
    """(seg_id, n_steps, role) of ``lengths``: dropped if shorter than n_wash + 2; of the others, in the order of
    seg_id, the first 80 % train and the rest test. Without a test time all train.

    Only the segments' list is ranked; the rank is built from counts of ranges, so no task sorts all segments."""
    usable = lengths.filter(F.col("n_steps") >= n_wash + 2)
    n = usable.count()
    if not n:
        raise ValueError(f"no segment has {n_wash + 2} steps")
    n_train = n if t_test == 0 else max(1, round(TRAIN_SHARE * n))
    last = usable.orderBy("seg_id").select("seg_id").offset(n_train - 1).limit(1).first()[0]
    role = F.when(F.col("n_steps") < n_wash + 2, "dropped").when(F.col("seg_id") <= last, "train").otherwise("test")
    return lengths.withColumn("role", role)


def ragged_n_val(lengths: DataFrame, n_wash: int) -> int:
    """The median usable segment's steps after wash-out, less one."""
    median = lengths.filter(F.col("n_steps") >= n_wash + 2).agg(F.median("n_steps")).first()[0]
    return max(1, int(median) - n_wash - 1)


def ragged_split(series: DataFrame, n_wash: int, t_test: float = 0.5) -> DataFrame:
    """One-step pairs with their segment's role; dropped segments are gone. Whole segments train or test."""
    roles = ragged_roles(segment_lengths(series), n_wash, t_test).filter("role <> 'dropped'").select("seg_id", "role")
    return pairs(series).join(roles, "seg_id")


def split_summary(lengths: DataFrame, n_wash: int, t_test: float = 0.5) -> DataFrame:
    """One row: segments in, dropped, training and testing, training pairs after wash-out, and n_val."""
    roles = ragged_roles(lengths, n_wash, t_test)
    is_ = lambda r: F.count(F.when(F.col("role") == r, 1))
    return roles.agg(
        F.count(F.lit(1)).alias("n_segments"), is_("dropped").alias("n_dropped"), is_("train").alias("n_train"), is_("test").alias("n_test"),
        F.sum(F.when(F.col("role") == "train", F.col("n_steps") - 1 - n_wash)).alias("kept_pairs"),
    ).withColumn("n_val", F.lit(ragged_n_val(lengths, n_wash)).cast("long"))


def test_windows(lengths: DataFrame, n_val: int, n_test: int, n_wash: int) -> DataFrame:
    """(seg_id, i0, u_from, u_to, y_from, y_to): short test windows every n_val steps while i0 + n_test fits; half-open.
    Windows whose target would be empty are left out."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - n_test - 1, F.lit(n_val).cast("long")))
    w = lengths.filter(F.col("n_steps") > n_test).select("seg_id", "n_steps", starts.alias("i0"))
    w = w.select("seg_id", "i0", F.col("i0").alias("u_from"), (F.col("i0") + n_test + n_wash - 1).alias("u_to"), (F.col("i0") + n_wash).alias("y_from"), F.least(F.col("i0") + n_test + n_wash, "n_steps").alias("y_to"))
    return w.filter(F.col("y_to") > F.col("y_from"))


def test_segments(lengths: DataFrame, n_wash: int, most: int, long: bool = True) -> DataFrame:
    """(seg_id, n_steps) of the segments that closed-loop tests use: the first ``most``, by seg_id, of those with
    n_wash steps, or twice as many for long tests. None is taken twice."""
    return lengths.filter(F.col("n_steps") >= n_wash * (2 if long else 1)).orderBy("seg_id").limit(most).select("seg_id", "n_steps")
