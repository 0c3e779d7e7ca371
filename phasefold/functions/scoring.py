"""Skill scores as Spark columns; pairs with a missing side are never scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAIRS = 5


def finite(c: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _both(y: Column, p: Column) -> Column:
    return finite(y).isNotNull() & finite(p).isNotNull()


def _scored(y: Column, p: Column, value: Column) -> Column:
    return F.when(F.count(F.when(_both(y, p), 1)) >= LEAST_PAIRS, value)


def correlation(y: Column, p: Column) -> Column:
    """Pearson correlation; null for a constant side (and never a division error)."""
    a, b = F.when(_both(y, p), y), F.when(_both(y, p), p)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return _scored(y, p, F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def correlation_or_zero(y: Column, p: Column) -> Column:
    return _scored(y, p, F.coalesce(correlation(y, p), F.lit(0.0)))


def clamped_correlation(y: Column, p: Column) -> Column:
    """Correlation whose denominator is at least 1e-8: about 0 for a constant side."""
    a, b = F.when(_both(y, p), y), F.when(_both(y, p), p)
    n = F.count(a)
    return F.covar_pop(a, b) * n / F.greatest(F.stddev_pop(a) * F.stddev_pop(b) * n, F.lit(1e-8))


def r2(y: Column, p: Column) -> Column:
    a = F.when(_both(y, p), y)
    rest = F.sum(F.when(_both(y, p), (y - p) * (y - p)))
    return _scored(y, p, 1 - F.try_divide(rest, F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0))))


def max_absolute_error(y: Column, p: Column) -> Column:
    return _scored(y, p, F.max(F.when(_both(y, p), F.abs(y - p))))


def sum_absolute_error(y: Column, p: Column) -> Column:
    return _scored(y, p, F.sum(F.when(_both(y, p), F.abs(y - p))))


def rmse(y: Column, p: Column) -> Column:
    return _scored(y, p, F.sqrt(F.avg(F.when(_both(y, p), (y - p) * (y - p)))))


def plain_correlation(y: Column, p: Column) -> Column:
    """Correlation of the finite pairs, however few; null for a constant side."""
    a, b = F.when(_both(y, p), y), F.when(_both(y, p), p)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"correlation": correlation_or_zero, "MAE": max_absolute_error, "CAE": sum_absolute_error, "RMSE": rmse, "R2": r2, "r2": r2, "plain": plain_correlation, "clamped": clamped_correlation}


#: The name of a metric or the user's own: a function of the actual and the predicted column.
Metric = str | Callable[[Column, Column], Column]


def metric(name: Metric) -> Callable[[Column, Column], Column]:
    """Score by name; 'MAE' is the largest and 'CAE' the summed absolute error. A function is taken as it is."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name]


def skill_by(rows: DataFrame, keys: list[str], by: Metric = "plain", strict: bool = False) -> DataFrame:
    """(keys, skill) of rows with pred and actual; ``strict``: null where any prediction is."""
    value = metric(by)(F.col("actual"), F.col("pred"))
    return rows.groupBy(*keys).agg((F.when(F.count("pred") == F.count("*"), value) if strict else value).alias("skill"))
