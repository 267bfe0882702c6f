"""Numeric helpers with fixed conventions for missing values, ties and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up by floor, which agrees between engines where ``round`` does not."""
    return (F.floor(x * 10.0**digits + 0.5) / 10.0**digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def average_rank(value: Column, *keys: str) -> Column:
    """Rank of ``value`` within ``keys`` from 1, ties share their mean rank, nulls have none."""
    by_value = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    return F.when(value.isNotNull(), F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percent_rank_average(value: Column, *keys: str) -> Column:
    """Average rank over the number of non-null values."""
    return average_rank(value, *keys) / F.count(value).over(Window.partitionBy(*keys))


def full(value: Column, window: WindowSpec, n: int, result: Column) -> Column:
    """``result`` over ``window`` once all ``n`` values in it are non-null."""
    return F.when(F.count(value).over(window) == n, result)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_add_exp(a: Column, b: Column) -> Column:
    """``ln(exp(a) + exp(b))`` without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def close_to(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def truthy(text: Column) -> Column:
    """Tolerant booleans; anything else is null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "t", "yes", "y"), True).when(word.isin("0", "false", "f", "no", "n"), False)
