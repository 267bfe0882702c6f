"""The test tables and the bar views derived from them.

``timestamp`` is a long of nanoseconds since 1970 UTC throughout; calendar
arithmetic divides it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.numeric import rounded

DAY = 86_400_000_000_000

#: The total order of trades.
TRADE_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_ns(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") * F.lit(DAY)


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one month per supplier from line items: ``timestamp, symbol, open, high, low, close, volume``.

    One aggregation with map-side partials; first and last trade by TRADE_KEY.
    """
    key = F.struct(*TRADE_KEY)
    rows = table(spark, sf_dir, "lineitem").select(
        day_ns(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("timestamp"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"),
        rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), key.alias("k"), "l_quantity",
    )
    return rows.groupBy("timestamp", "symbol").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


BARS = """
bars AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', l_shipdate) AS DATE)) AS BIGINT) * 86400000000000 AS timestamp,
    lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol,
    arg_min(floor(l_extendedprice / l_quantity * 1e6 + 0.5) / 1e6, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_suppkey, f := l_quantity, g := l_extendedprice)) AS open,
    max(floor(l_extendedprice / l_quantity * 1e6 + 0.5) / 1e6) AS high, min(floor(l_extendedprice / l_quantity * 1e6 + 0.5) / 1e6) AS low,
    arg_max(floor(l_extendedprice / l_quantity * 1e6 + 0.5) / 1e6, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_suppkey, f := l_quantity, g := l_extendedprice)) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2)
"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one day per event type, price = value."""
    rows = table(spark, sf_dir, "events").select(day_ns(F.col("ts")).alias("timestamp"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("k"))
    return rows.groupBy("timestamp", "symbol").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.count("*").alias("volume")
    )


DAILY = """
daily AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400000000000 AS timestamp, event_type AS symbol,
    arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)
"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills: returned items are sells."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), day_ns(F.col("l_shipdate")).alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("long").alias("quantity"),
        rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), rounded(F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        "l_linenumber", "l_partkey", "l_linestatus",
    )


FILLS = """
fills AS (
  SELECT l_orderkey AS order_id, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000000000 AS timestamp,
    CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
    floor(l_extendedprice / l_quantity * 1e6 + 0.5) / 1e6 AS price, floor(l_extendedprice * l_tax * 1e6 + 0.5) / 1e6 AS fee, l_linenumber, l_partkey, l_linestatus
  FROM lineitem)
"""
