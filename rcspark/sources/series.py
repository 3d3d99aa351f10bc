"""Time series from tables, in the canonical frame (seg_id long, t long, y array<double>[, p array<double>])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_series(df: DataFrame, seg: Column, order: Sequence[Column], y: Sequence[Column], p: Sequence[Column] = ()) -> DataFrame:
    """``t`` is the row's place in its segment, from 0. Ties in ``order`` must be broken by the caller."""
    cols = [seg.cast("long").alias("seg_id"), F.array(*[c.cast("double") for c in y]).alias("y")]
    cols += [F.array(*[c.cast("double") for c in p]).alias("p")] * bool(p)
    place = Window.partitionBy("seg_id").orderBy(*[f"_o{i}" for i in range(len(order))])
    keyed = df.select(*cols, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    out = keyed.withColumn("t", F.row_number().over(place).cast("long") - 1)
    return out.select("seg_id", "t", "y", *["p"] * bool(p))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged, one dimension: each user's event values in time order."""
    e = table(spark, sf_dir, "events")
    return to_series(e, F.col("user_id"), [F.col("ts"), F.col("event_id")], [F.col("value")])


def daily_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment of three dimensions: quantity, price and mean discount of each ship day."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("x"), F.round(F.avg("l_discount"), 6).alias("d")
    )
    return to_series(days, F.lit(0), [F.col("day")], [F.col("q"), F.col("x"), F.col("d")])


def region_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each region: orders and their total price of each day; the parameters are the region's number,
    constant, and the day's weekday."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    nation = F.broadcast(nation) if nation.count() < 100_000 else nation
    days = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("x"))
    )
    return to_series(days, F.col("n_regionkey"), [F.col("day")], [F.col("n"), F.col("x")], [F.col("n_regionkey"), F.dayofweek("day")])
