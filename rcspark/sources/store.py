"""Model snapshots as Parquet: config, and one coordinate table for each matrix."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..plans.model import Model


def coordinates(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(i, j, w) of the entries that aren't 0."""
    i, j = np.nonzero(x)
    return spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)], "i int, j int, w double")


def dense(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.w
    return out


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Search traces and summaries aren't kept. An untrained model has no ``w_out``."""
    row = (json.dumps(asdict(model.cfg)), [float(x) for x in model.norm], [float(x) for x in model.shift], model.trained)
    spark.createDataFrame([row], "config string, norm array<double>, shift array<double>, trained boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    for name, x in (("w_in", model.w_in), ("w_res", model.w), ("w_out", model.w_out)):
        if x is not None:
            coordinates(spark, x).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(f"{path}/config").first()
    raw = json.loads(row.config)
    cfg = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    n = cfg.n_units
    read = lambda name, shape: dense(spark.read.parquet(f"{path}/{name}"), shape)
    w_out = read("w_out", (n + 1, cfg.n_dim)) if row.trained else None
    return Model(cfg, read("w_in", (n, cfg.n_dim_in + 1)), read("w_res", (n, n)), w_out, np.array(row.norm), np.array(row.shift))
