"""Short forms for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import rounded
from tickforge.sources.tables import BARS, monthly_bars

#: 1998-01-01 and 1999-12-01 in nanoseconds.
FROM, TO = 883_612_800_000_000_000, 944_006_400_000_000_000


def r(expression: str, digits: int = 6) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def rounded_columns(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*(rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Bars as predictions: the score is the last log return, the label the next simple return, relevance its fifth."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    out = monthly_bars(spark, sf_dir).select(
        "timestamp", "symbol", *keep, rounded(F.ln("close") - F.ln(F.lag("close").over(w))).alias("score"), rounded(F.lead("close").over(w) / F.col("close") - 1).alias("label")
    )
    out = out.filter("score is not null and label is not null")
    by = Window.partitionBy("timestamp")
    rank = F.row_number().over(by.orderBy("label", "symbol")) - 1
    return out.withColumn("relevance", F.floor(rank * 5 / F.count("*").over(by)).cast("int"))


SCORED = (
    BARS
    + """,
scored0 AS (
  SELECT timestamp, symbol, floor((ln(close) - ln(lag(close) OVER w)) * 1e6 + 0.5) / 1e6 AS score, floor((lead(close) OVER w / close - 1) * 1e6 + 0.5) / 1e6 AS label
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
scored AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY timestamp ORDER BY label, symbol) - 1) * 5 / count(*) OVER (PARTITION BY timestamp)) AS INTEGER) AS relevance
  FROM scored0 WHERE score IS NOT NULL AND label IS NOT NULL)
"""
)
