"""Scans, metadata, checks and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.numeric import rounded
from tickforge.operators import scan as S
from tickforge.operators.ranges import running_sums
from tickforge.plans.common import FROM, TO, r
from tickforge.sources import generate as G
from tickforge.sources.tables import BARS, DAILY, FILLS, daily_bars, fills, monthly_bars, table

_SYMBOLS = ("000001", "000003", "000007")
_IN = "('000001', '000003', '000007')"
_COLS = "timestamp, symbol, open, high, low, close, volume"
_BAD = "volume % 7 = 0"


def _dirty(spark, sf):
    """Bars with planted faults."""
    bad = F.col("volume") % 7 == 0
    return monthly_bars(spark, sf).withColumns({"high": F.when(bad, F.col("low") / 2).otherwise(F.col("high")), "volume": F.when(F.col("volume") % 11 == 0, -F.col("volume")).otherwise(F.col("volume"))})


_DIRTY = BARS + ", dirty AS (SELECT timestamp, symbol, open, CASE WHEN volume % 7 = 0 THEN low / 2 ELSE high END AS high, low, close, CASE WHEN volume % 11 = 0 THEN -volume ELSE volume END AS volume FROM bars)"


def _enriched(spark, sf):
    factor = (1 + F.col("volume") % 3 / 10.0).cast("double")
    b = monthly_bars(spark, sf).withColumns({"factor": factor, "lot_size": F.when(F.col("volume") % 13 == 0, 0.5).otherwise(100.0), "upper_limit": F.col("close") * 1.1, "lower_limit": F.col("close") * 0.9})
    return b.withColumns({f"signal_{c}": F.when(F.col("volume") % 17 == 0, F.col(c)).otherwise(F.col(c) * F.col("factor")) for c in ("open", "high", "low", "close")})


def _minute(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))


QUERIES = {
    "lake_query": (lambda s, d: S.query(monthly_bars(s, d), _SYMBOLS, FROM, TO), f"WITH {BARS} SELECT {_COLS} FROM bars WHERE symbol IN {_IN} AND timestamp BETWEEN {FROM} AND {TO}"),
    "lake_cross_section": (lambda s, d: S.cross_section(monthly_bars(s, d), FROM), f"WITH {BARS} SELECT {_COLS} FROM bars WHERE timestamp = {FROM}"),
    "lake_history": (lambda s, d: S.history(monthly_bars(s, d), "000002", FROM, TO), f"WITH {BARS} SELECT {_COLS} FROM bars WHERE symbol = '000002' AND timestamp BETWEEN {FROM} AND {TO}"),
    "scan_unsorted": (lambda s, d: S.query(monthly_bars(s, d), None, FROM, TO, ["symbol", "close"], ordered=False), f"WITH {BARS} SELECT symbol, close FROM bars WHERE timestamp BETWEEN {FROM} AND {TO}"),
    "sort_ts_symbol": (lambda s, d: S.query(monthly_bars(s, d)), f"WITH {BARS} SELECT {_COLS} FROM bars"),
    "sort_chunked_replay": (
        lambda s, d: S.sliced_replay(monthly_bars(s, d), 8).groupBy("slice").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")),
        f"WITH {BARS}, t AS (SELECT timestamp, count(*) AS n FROM bars GROUP BY 1), c AS (SELECT timestamp, n, CAST(floor(coalesce(sum(n) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / sum(n) OVER ()) AS INTEGER) AS slice FROM t) SELECT slice, CAST(sum(n) AS BIGINT) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM c GROUP BY 1",
    ),
    "src_parquet_bars": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").filter("l_quantity > 45"), "SELECT l_orderkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45"),
    "src_file_store": (lambda s, d: S.query(S.normalise(monthly_bars(s, d)), _SYMBOLS, FROM, TO, ["timestamp", "symbol", "close"]), f"WITH {BARS} SELECT timestamp, symbol, close FROM bars WHERE symbol IN {_IN} AND timestamp BETWEEN {FROM} AND {TO}"),
    "src_symbol_override": (lambda s, d: S.history(monthly_bars(s, d), "000001", FROM, TO).withColumn("symbol", F.lit("INDEX")), f"WITH {BARS} SELECT timestamp, 'INDEX' AS symbol, open, high, low, close, volume FROM bars WHERE symbol = '000001' AND timestamp BETWEEN {FROM} AND {TO}"),
    "src_latest_asof": (lambda s, d: S.latest(monthly_bars(s, d), "000004", TO), f"WITH {BARS} SELECT {_COLS} FROM bars WHERE symbol = '000004' AND timestamp <= {TO} ORDER BY timestamp DESC LIMIT 1"),
    "src_optional_columns": (
        lambda s, d: S.with_defaults(monthly_bars(s, d).withColumn("upper_limit", F.when(F.col("volume") % 2 == 0, F.col("high"))), {"upper_limit": 0.0, "lower_limit": 0.0, "is_suspended": False}).select("timestamp", "symbol", "upper_limit", "lower_limit", "is_suspended"),
        f"WITH {BARS} SELECT timestamp, symbol, CASE WHEN volume % 2 = 0 THEN high ELSE 0.0 END AS upper_limit, CAST(0.0 AS DOUBLE) AS lower_limit, false AS is_suspended FROM bars",
    ),
    "src_multi_file_concat": (
        lambda s, d: monthly_bars(s, d).select("timestamp", "symbol", "close").unionByName(daily_bars(s, d).select("timestamp", "symbol", "close")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_ts")),
        f"WITH {BARS}, {DAILY} SELECT symbol, count(*) AS n, max(timestamp) AS last_ts FROM (SELECT timestamp, symbol FROM bars UNION ALL SELECT timestamp, symbol FROM daily) GROUP BY 1",
    ),
    "set_union_all": (
        lambda s, d: monthly_bars(s, d).select("timestamp", "symbol").unionByName(daily_bars(s, d).select("timestamp", "symbol")),
        f"WITH {BARS}, {DAILY} SELECT timestamp, symbol FROM bars UNION ALL SELECT timestamp, symbol FROM daily",
    ),
    "src_minute_fixture": (
        lambda s, d: G.minute_fixture(s, 20, 2, 30),
        "SELECT CAST(1767225600 + d * 86400 + m * 60 AS BIGINT) * 1000000000 AS timestamp, lpad(CAST(i AS VARCHAR), 6, '0') AS symbol, floor((10 + (i % 100) / 10 + m / 10000) * 1e6 + 0.5) / 1e6 AS close, CAST(10000 AS BIGINT) AS volume FROM range(20) a(i), range(2) b(d), range(30) c(m)",
    ),
    "meta_summary": (lambda s, d: monthly_bars(s, d).agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")), f"WITH {BARS} SELECT count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM bars"),
    "meta_list_symbols": (lambda s, d: monthly_bars(s, d).select("symbol").distinct().orderBy("symbol"), f"WITH {BARS} SELECT DISTINCT symbol FROM bars"),
    "agg_min_max_ts": (lambda s, d: monthly_bars(s, d).groupBy("symbol").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")), f"WITH {BARS} SELECT symbol, min(timestamp) AS lo, max(timestamp) AS hi FROM bars GROUP BY 1"),
    "symbol_set_normalise": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("symbols")),
        "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS symbols FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1",
    ),
    "normalise_bars": (
        lambda s, d: S.normalise(monthly_bars(s, d)).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).select(F.col("year").cast("int"), F.col("month").cast("int"), "n", "volume"),
        f"WITH {BARS} SELECT CAST(year(to_timestamp(timestamp / 1000000000 + 28800)) AS INTEGER) AS year, CAST(month(to_timestamp(timestamp / 1000000000 + 28800)) AS INTEGER) AS month, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2",
    ),
    "validate_bars": (
        lambda s, d: S.validate(_dirty(s, d)),
        f"WITH {_DIRTY} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS null_value, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS bad_range, count(*) FILTER (volume < 0) AS negative_volume, CAST(0 AS BIGINT) AS bad_timestamp, CAST(0 AS BIGINT) AS empty_symbol FROM dirty",
    ),
    "validate_execution_rows": (
        lambda s, d: _enriched(s, d).agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(k) for k, c in S.execution_problems().items())),
        f"WITH {BARS} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_limits, count(*) FILTER (volume % 13 = 0) AS bad_lot, CAST(0 AS BIGINT) AS outside_limits FROM bars",
    ),
    "validate_signal_consistency": (
        lambda s, d: _enriched(s, d).agg(F.count("*").alias("n_rows"), F.count_if(S.signal_problems()).alias("n_bad")),
        f"WITH {BARS} SELECT count(*) AS n_rows, count(*) FILTER (volume % 17 = 0 AND volume % 3 <> 0) AS n_bad FROM bars",
    ),
    "validate_snapshot": (
        lambda s, d: _dirty(s, d).select("timestamp", "symbol", F.greatest(*(c for k, c in S.bar_problems().items())).alias("bad")).filter("bad").select("timestamp", "symbol"),
        f"WITH {_DIRTY} SELECT timestamp, symbol FROM dirty WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR volume < 0 OR least(open, high, low, close) <= 0",
    ),
    "dup_key_batch": (
        lambda s, d: S.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "dup_key_against_lake": (
        lambda s, d: S.conflicts(monthly_bars(s, d).filter(F.col("timestamp") >= FROM), monthly_bars(s, d).filter(F.col("timestamp") <= TO)).groupBy().agg(F.count("*").alias("n")),
        f"WITH {BARS} SELECT count(*) AS n FROM bars WHERE timestamp BETWEEN {FROM} AND {TO}",
    ),
    "order_guard": (
        lambda s, d: S.order_violations(table(s, d, "events").select("event_id", F.col("user_id").alias("u"), "event_type"), "event_id", "u", "event_type").agg(F.count("*").alias("n")),
        "SELECT count(*) AS n FROM (SELECT user_id AS u, event_type AS e, lag(user_id) OVER w AS pu, lag(event_type) OVER w AS pe FROM events WINDOW w AS (ORDER BY event_id)) WHERE pu IS NOT NULL AND (u < pu OR (u = pu AND e <= pe))",
    ),
    "trading_minute_filter": (
        lambda s, d: _minute(s, d).withColumn("session", S.session_of(F.col("minute"))).filter("session is not null").groupBy("session").agg(F.count("*").alias("n")),
        "SELECT session, count(*) AS n FROM (SELECT CASE WHEN m > 555 AND m <= 565 THEN 'OPENING_AUCTION' WHEN m > 570 AND m <= 690 THEN 'MORNING' WHEN m > 780 AND m <= 897 THEN 'AFTERNOON' WHEN m > 897 AND m <= 900 THEN 'CLOSING_AUCTION' END AS session FROM (SELECT hour(ts) * 60 + minute(ts) AS m FROM events)) WHERE session IS NOT NULL GROUP BY 1",
    ),
    "is_trading_day": (
        lambda s, d: table(s, d, "events").withColumn("date", F.to_date("ts")).join(table(s, d, "events").select(F.to_date("ts").alias("date")).distinct().filter(F.weekday("date") < 5), "date", "left_semi").groupBy("date").agg(F.count("*").alias("n")),
        "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE isodow(ts) < 6 GROUP BY 1",
    ),
    "pit_guard": (
        lambda s, d: S.late_knowledge(monthly_bars(s, d).withColumn("known_at", F.col("timestamp") + F.when(F.col("volume") % 5 == 0, 1).otherwise(-1))),
        f"WITH {BARS} SELECT count(*) AS n_rows, count(*) FILTER (volume % 5 = 0) AS n_future FROM bars",
    ),
    "set_intersect": (
        lambda s, d: table(s, d, "lineitem").filter("l_returnflag = 'A'").select("l_suppkey").intersect(table(s, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select("l_suppkey")),
        "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
    ),
    "set_except": (
        lambda s, d: table(s, d, "customer").select("c_custkey").exceptAll(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()),
        "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    ),
    "set_jaccard": (
        lambda s, d: _jaccard(s, d),
        f"WITH {FILLS}, a AS (SELECT DISTINCT symbol, l_partkey AS p FROM fills WHERE side = 'BUY'), b AS (SELECT DISTINCT symbol, l_partkey AS p FROM fills WHERE side = 'SELL') SELECT coalesce(a.symbol, b.symbol) AS symbol, {r('count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) * 1.0 / count(*)')} AS jaccard FROM a FULL JOIN b ON a.symbol = b.symbol AND a.p = b.p GROUP BY 1",
    ),
    "set_universe_diff": (
        lambda s, d: _diff(s, d),
        "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1998) SELECT CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'kept' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1",
    ),
    "limit_offset_page": (lambda s, d: fills(s, d).orderBy("timestamp", "order_id", "l_linenumber", "l_partkey", "quantity", "price", "symbol").select("timestamp", "order_id", "quantity").offset(100).limit(50), f"WITH {FILLS} SELECT timestamp, order_id, quantity FROM fills ORDER BY timestamp, order_id, l_linenumber, l_partkey, quantity, price, symbol LIMIT 50 OFFSET 100"),
    "latest_runs": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "ordered_sample": (
        lambda s, d: _sample(s, d),
        f"WITH {BARS}, o AS (SELECT timestamp, symbol, close, row_number() OVER (ORDER BY close, timestamp, symbol) - 1 AS i, count(*) OVER () AS n FROM bars), k AS (SELECT CAST(floor(j * ((SELECT max(n) FROM o) - 1) / 63.0) AS BIGINT) AS i FROM range(64) t(j)) SELECT timestamp, symbol, close FROM o JOIN (SELECT DISTINCT i FROM k) USING (i)",
    ),
}


def _jaccard(spark, sf):
    f = fills(spark, sf).select("symbol", F.col("l_partkey").alias("p"), "side").distinct()
    by = f.groupBy("symbol", "p").agg(F.count("*").alias("n"))
    return by.groupBy("symbol").agg(rounded(F.count_if(F.col("n") == 2) / F.count("*")).alias("jaccard"))


def _diff(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k")).distinct() for y in (1997, 1998))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept").alias("status")).agg(F.count("*").alias("n"))


def _sample(spark, sf, most: int = 64):
    """Rows at evenly spaced places of the total order."""
    o = monthly_bars(spark, sf).select("timestamp", "symbol", "close").withColumn("one", F.lit(1))
    o = running_sums(o, ["close", "timestamp", "symbol"], "one")
    n = monthly_bars(spark, sf).count()
    wanted = sorted({int(j * (n - 1) / (most - 1)) + 1 for j in range(most)})
    return o.filter(F.col("one_upto").isin(wanted)).drop("one", "one_upto")
