"""Error metrics as aggregate expressions over rows of (truth, prediction, norm) vectors, and a registry of probes.

A row's vectors are averaged over rows and dimensions together, as one mean.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import is_finite

#: Fixed penalties of diverged probes and the guard of the mean square.
LOG_PENALTY, SQUARE_PENALTY, TINY = 10.0, 1e6, 1e-14


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def nmae(y: Column, yhat: Column, norm: Column) -> Column:
    """mean|y - yhat| / mean|norm|; null if the norm is 0."""
    error = F.sum(_sum(F.zip_with(y, yhat, lambda a, b: F.abs(a - b)))) / F.sum(F.size(y))
    scale = F.sum(_sum(F.transform(norm, F.abs))) / F.sum(F.size(norm))
    return F.try_divide(error, scale)


def nrmse(y: Column, yhat: Column, norm: Column) -> Column:
    """The old name of ``nmae``."""
    warnings.warn("nrmse is nmae's old name", DeprecationWarning, stacklevel=2)
    return nmae(y, yhat, norm)


def log_of(error: Column, perfect_is_penalty: bool = True) -> Column:
    """log10, or the penalty where that isn't finite. A perfect probe (error 0) scores the penalty too, unless told
    otherwise, when it scores -16."""
    best = F.lit(LOG_PENALTY if perfect_is_penalty else -16.0)
    return F.when(error == 0, best).when(is_finite(error) & (error > 0), F.log10(error)).otherwise(F.lit(LOG_PENALTY))


def log_nmae(y: Column, yhat: Column, norm: Column) -> Column:
    return log_of(nmae(y, yhat, norm))


def nmse(y: Column, yhat: Column, norm: Column | None = None) -> Column:
    """mean (y - yhat)**2 / (mean y**2 + tiny); the norm is ignored."""
    n = F.sum(F.size(y))
    error = F.sum(_sum(F.zip_with(y, yhat, lambda a, b: (a - b) * (a - b)))) / n
    m = error / (F.sum(_sum(F.transform(y, lambda a: a * a))) / n + F.lit(TINY))
    return F.when(is_finite(m), m).otherwise(F.lit(SQUARE_PENALTY))


#: Name -> metric(y, yhat, norm), an aggregate column. Callers may add their own.
REGISTRY: dict[str, Callable[[Column, Column, Column], Column]] = {"log_nmae": log_nmae, "nmse": nmse, "nmae": nmae}


def metric(name: str | Callable | None) -> Callable[[Column, Column, Column], Column]:
    if name is None:
        return log_nmae
    if callable(name):
        return name
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]
