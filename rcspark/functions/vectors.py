"""Array columns as vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dims(column: str, n: int, prefix: str) -> list[Column]:
    return [F.get(F.col(column), F.lit(i)).alias(f"{prefix}{i}") for i in range(n)]


def pick(column: Column | str, idx: Sequence[int]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array(*[F.get(column, F.lit(i)) for i in idx])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
