"""Deterministic generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.numeric import rounded


def minute_fixture(spark: SparkSession, symbols: int = 1000, days: int = 5, minutes: int = 240) -> DataFrame:
    """symbols x days x minutes, from one range: no join, any number of partitions."""
    i, rest = F.col("id") % symbols, F.floor(F.col("id") / symbols)
    day, minute = F.floor(rest / minutes), rest % minutes
    rows = spark.range(symbols * days * minutes)
    seconds = F.lit(1767225600) + day * 86400 + minute * 60
    return rows.select(
        (seconds * 1_000_000_000).cast("long").alias("timestamp"), F.lpad(i.cast("string"), 6, "0").alias("symbol"),
        rounded(10 + (i % 100) / 10 + minute / 10000).alias("close"), F.lit(10000).cast("long").alias("volume"),
    )


def sample_daily(spark: SparkSession, n: int = 250, seed: int = 42) -> DataFrame:
    """One symbol: a 60-bar sine with noise of a linear congruential generator."""
    import math

    rows, state = [], seed
    for t in range(n):
        state = (1103515245 * state + 12345) % (1 << 31)
        close = 10 + 2 * math.sin(2 * math.pi * t / 60) + (state / (1 << 31) - 0.5) * 0.2
        rows.append((1_704_067_200_000_000_000 + t * 86_400_000_000_000, "SAMPLE", close * 0.999, close * 1.01, close * 0.99, close, 100_000 + state % 1000))
    return spark.createDataFrame(rows, "timestamp long, symbol string, open double, high double, low double, close double, volume long")
