"""Joins in time and by key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import rounded
from tickforge.operators import backtest as B
from tickforge.operators import metrics as M
from tickforge.operators import temporal as T
from tickforge.plans.common import SCORED, r, scored
from tickforge.sources.tables import BARS, DAY, FILLS, fills, monthly_bars, table


def _factors(spark, sf):
    """Quarterly factors of each supplier, known 10 days after the quarter begins."""
    b = monthly_bars(spark, sf).filter((F.col("timestamp") / F.lit(DAY * 31) % 3).cast("int") == 0)
    return b.select("symbol", (F.col("timestamp") + 10 * DAY).alias("known_at"), rounded(1 + F.col("volume") / 1000.0).alias("factor"))


_FACTORS = BARS + f", factors AS (SELECT symbol, timestamp + {10 * DAY} AS known_at, {r('1 + volume / 1000.0')} AS factor FROM bars WHERE CAST(floor(timestamp / {DAY * 31}.0 % 3) AS INTEGER) = 0)"


def _states(spark, sf):
    """Half-open intervals per symbol that do not overlap; the last one is open."""
    f = _factors(spark, sf)
    w = Window.partitionBy("symbol").orderBy("known_at")
    return f.select("symbol", F.col("known_at").alias("effective_from"), F.lead("known_at").over(w).alias("effective_to"), (F.col("factor") > 1.1).alias("is_st"), "factor")


_STATES = _FACTORS + ", states AS (SELECT symbol, known_at AS effective_from, lead(known_at) OVER (PARTITION BY symbol ORDER BY known_at) AS effective_to, factor > 1.1 AS is_st, factor FROM factors)"
_IN_STATE = "b.symbol = s.symbol AND b.timestamp >= s.effective_from AND (s.effective_to IS NULL OR b.timestamp < s.effective_to)"


def _fees(spark, sf):
    rows = [(0, 852076800000000000, 0.001, 5.0, 0.001), (852076800000000000, 915148800000000000, 0.0005, 5.0, 0.001), (915148800000000000, None, 0.0003, 1.0, 0.0005)]
    return spark.createDataFrame(rows, "effective_from long, effective_to long, rate double, least double, stamp double")


_FEES = "fees AS (SELECT * FROM (VALUES (0, 852076800000000000, 0.001, 5.0, 0.001), (852076800000000000, 915148800000000000, 0.0005, 5.0, 0.001), (915148800000000000, NULL, 0.0003, 1.0, 0.0005)) t(effective_from, effective_to, rate, least_fee, stamp))"


def _fee_join(s, d):
    f = fills(s, d).select("order_id", "timestamp", "side", "quantity", "price")
    # three rows: the schedule is a constant, so its broadcast is bounded
    out = T.interval(f, F.broadcast(_fees(s, d)), [], how="inner")
    return out.withColumn("fee", B.commission(F.col("price") * F.col("quantity"), F.col("side") == "SELL", F.col("rate"), F.col("least"), F.col("stamp")))


def _range_actions(s, d):
    events = fills(s, d).filter("side = 'SELL'").select("symbol", (F.col("timestamp") + 3600).alias("event_at"), "quantity")
    out = T.between_bars(monthly_bars(s, d), events)
    return out.groupBy("symbol", "bar_at").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


def _skeleton(s, d):
    b = monthly_bars(s, d).filter(F.col("volume") % 4 != 0)
    calendar = monthly_bars(s, d).select("timestamp", "symbol")
    return T.skeleton(calendar, b).select("timestamp", "symbol", "open", "high", "low", "close", "volume", "bar_observed")


def _reconcile(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("quantity"))
    f = fills(s, d).groupBy("order_id").agg(F.sum("quantity").alias("quantity"))
    local = o.join(f.select("order_id"), "order_id", "left_semi").filter("order_id % 3 <> 0").withColumn("quantity", F.col("order_id") % 50)
    remote = f.filter("order_id % 5 <> 0").withColumn("quantity", F.when(F.col("order_id") % 7 == 0, F.col("order_id") % 49).otherwise(F.col("order_id") % 50))
    return T.reconcile(local, remote).groupBy("status").agg(F.count("*").alias("n"))


def _paired(s, d):
    x = scored(s, d).withColumn("model", F.when(F.crc32("symbol") % 2 == 0, "a").otherwise("b"))
    by = x.groupBy("model", "timestamp").agg(F.avg("score").alias("m"))
    a, b = (by.filter(F.col("model") == k).select("timestamp", F.col("m").alias(k)) for k in "ab")
    return a.join(b, "timestamp").select("timestamp", rounded(F.col("a") - F.col("b")).alias("delta"))


_EVEN = "CAST(symbol AS INTEGER) % 2 = 0"

QUERIES = {
    "join_asof_backward": (
        lambda s, d: T.asof(monthly_bars(s, d).select("timestamp", "symbol", "close"), _factors(s, d), "timestamp", "known_at").withColumnRenamed("known_at_asof", "known_at").withColumn("adjusted", rounded(F.col("close") * F.coalesce("factor", F.lit(1.0)))),
        f"WITH {_FACTORS} SELECT b.timestamp, b.symbol, b.close, f.known_at, f.factor, {r('b.close * coalesce(f.factor, 1.0)')} AS adjusted FROM bars b ASOF LEFT JOIN factors f ON b.symbol = f.symbol AND b.timestamp >= f.known_at",
    ),
    "join_asof_snapshot": (
        lambda s, d: T.asof(
            monthly_bars(s, d).select("timestamp", "symbol"),
            T.keep_last(fills(s, d).select("symbol", F.col("timestamp").alias("known_at"), F.col("l_partkey").alias("industry"), "order_id"), ["symbol", "known_at"], "industry", "order_id").select("symbol", "known_at", "industry"),
            "timestamp", "known_at",
        ).withColumnRenamed("known_at_asof", "known_at"),
        f"WITH {BARS}, {FILLS}, k AS (SELECT symbol, timestamp AS known_at, max(l_partkey) AS industry FROM fills GROUP BY 1, 2) SELECT b.timestamp, b.symbol, k.known_at, k.industry FROM bars b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.timestamp >= k.known_at",
    ),
    "join_interval_state": (
        lambda s, d: T.interval_asof(monthly_bars(s, d).select("timestamp", "symbol"), _states(s, d), "symbol").select("timestamp", "symbol", "is_st", "effective_to"),
        f"WITH {_STATES} SELECT b.timestamp, b.symbol, s.is_st, s.effective_to FROM bars b LEFT JOIN states s ON {_IN_STATE}",
    ),
    "join_interval_factor": (
        lambda s, d: T.interval(monthly_bars(s, d).select("timestamp", "symbol"), _states(s, d), ["symbol"]).select("timestamp", "symbol", F.coalesce("factor", F.lit(1.0)).alias("factor")),
        f"WITH {_STATES} SELECT b.timestamp, b.symbol, coalesce(s.factor, 1.0) AS factor FROM bars b LEFT JOIN states s ON {_IN_STATE}",
    ),
    "join_interval_fee": (
        lambda s, d: _fee_join(s, d).groupBy("rate").agg(F.count("*").alias("n"), rounded(F.sum("fee"), 2).alias("fee")),
        f"WITH {FILLS}, {_FEES} SELECT CAST(rate AS DOUBLE) AS rate, count(*) AS n, {r('sum(greatest(price * quantity * CAST(rate AS DOUBLE), CAST(least_fee AS DOUBLE)) + CASE WHEN side = CHR(83) || CHR(69) || CHR(76) || CHR(76) THEN price * quantity * CAST(stamp AS DOUBLE) ELSE 0 END)', 2)} AS fee FROM fills JOIN fees ON timestamp >= effective_from AND (effective_to IS NULL OR timestamp < effective_to) GROUP BY 1",
    ),
    "bt_commission": (
        lambda s, d: _fee_join(s, d).select("order_id", "side", rounded(F.col("fee"), 4).alias("fee")).groupBy("side").agg(rounded(F.min("fee"), 4).alias("lo"), rounded(F.max("fee"), 4).alias("hi")),
        f"WITH {FILLS}, {_FEES}, x AS (SELECT side, {r('greatest(price * quantity * CAST(rate AS DOUBLE), CAST(least_fee AS DOUBLE)) + CASE side WHEN $$SELL$$ THEN price * quantity * CAST(stamp AS DOUBLE) ELSE 0 END', 4)} AS fee FROM fills JOIN fees ON timestamp >= effective_from AND (effective_to IS NULL OR timestamp < effective_to)) SELECT side, {r('min(fee)', 4)} AS lo, {r('max(fee)', 4)} AS hi FROM x GROUP BY 1",
    ),
    "interval_overlap_check": (
        lambda s, d: T.overlaps(_states(s, d).withColumn("effective_to", F.when(F.col("is_st"), F.col("effective_to") + 1).otherwise(F.col("effective_to"))), ["symbol"]).select("symbol", "effective_from"),
        f"WITH {_STATES} SELECT symbol, effective_from FROM states WHERE is_st AND effective_to IS NOT NULL",
    ),
    "join_range_actions": (
        _range_actions,
        f"WITH {BARS}, {FILLS}, t AS (SELECT symbol, timestamp AS bar_at, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev FROM bars) SELECT t.symbol, bar_at, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM t JOIN fills f ON f.symbol = t.symbol AND side = 'SELL' AND f.timestamp + 3600 <= bar_at AND (prev IS NULL OR f.timestamp + 3600 > prev) GROUP BY 1, 2",
    ),
    "join_exact_state": (
        lambda s, d: monthly_bars(s, d).select("timestamp", "symbol", "close").join(monthly_bars(s, d).filter("volume % 2 = 0").select("timestamp", "symbol", F.col("volume").alias("state")), ["timestamp", "symbol"]),
        f"WITH {BARS} SELECT timestamp, symbol, close, volume AS state FROM bars WHERE volume % 2 = 0",
    ),
    "join_left_rules": (
        lambda s, d: monthly_bars(s, d).select("timestamp", "symbol").join(monthly_bars(s, d).filter("volume % 3 = 0").groupBy("timestamp").agg(F.max("high").alias("upper")), "timestamp", "left"),
        f"WITH {BARS}, u AS (SELECT timestamp, max(high) AS upper FROM bars WHERE volume % 3 = 0 GROUP BY 1) SELECT timestamp, symbol, upper FROM bars LEFT JOIN u USING (timestamp)",
    ),
    "join_left_skeleton": (
        _skeleton,
        f"WITH {BARS}, x AS (SELECT timestamp, symbol, CASE WHEN volume % 4 <> 0 THEN open END AS o, CASE WHEN volume % 4 <> 0 THEN high END AS h, CASE WHEN volume % 4 <> 0 THEN low END AS l, CASE WHEN volume % 4 <> 0 THEN close END AS c, CASE WHEN volume % 4 <> 0 THEN volume END AS v FROM bars), y AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM x) SELECT timestamp, symbol, coalesce(o, p) AS open, coalesce(h, p) AS high, coalesce(l, p) AS low, coalesce(c, p) AS close, coalesce(v, 0) AS volume, c IS NOT NULL AS bar_observed FROM y WHERE p IS NOT NULL",
    ),
    "win_ffill": (
        lambda s, d: monthly_bars(s, d).withColumn("x", F.when(F.col("volume") % 3 == 0, F.col("close"))).select("timestamp", "symbol", F.last("x", True).over(Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)).alias("x")),
        f"WITH {BARS} SELECT timestamp, symbol, last_value(CASE WHEN volume % 3 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM bars",
    ),
    "join_left_anti": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "join_semi_universe": (
        lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier").filter("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n")),
        "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1",
    ),
    "join_semi_dup": (
        lambda s, d: table(s, d, "lineitem").join(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_semi").agg(F.count("*").alias("n")),
        "SELECT count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
    "universe_at": (
        lambda s, d: T.interval(monthly_bars(s, d).select("timestamp", "symbol").filter(F.col("timestamp") == 915148800000000000), _states(s, d), ["symbol"], how="inner").filter("not is_st").select("symbol"),
        f"WITH {_STATES} SELECT b.symbol FROM bars b JOIN states s ON {_IN_STATE} WHERE timestamp = 915148800000000000 AND NOT is_st",
    ),
    "join_pred_label": (
        lambda s, d: scored(s, d).select("timestamp", "symbol", F.col("score").alias("score_pred")).join(scored(s, d).select("timestamp", "symbol", F.col("label").alias("label_true")), ["timestamp", "symbol"]),
        f"WITH {SCORED} SELECT timestamp, symbol, score AS score_pred, label AS label_true FROM scored",
    ),
    "join_pred_bars_default": (
        lambda s, d: monthly_bars(s, d).select("timestamp", "symbol").join(scored(s, d).select("timestamp", "symbol", "score"), ["timestamp", "symbol"], "left").select("timestamp", "symbol", F.coalesce("score", F.lit(-1.0)).alias("expected_return"), F.lit(1.0).alias("confidence")),
        f"WITH {SCORED} SELECT timestamp, symbol, coalesce(score, -1.0) AS expected_return, CAST(1.0 AS DOUBLE) AS confidence FROM bars LEFT JOIN scored USING (timestamp, symbol)",
    ),
    "bt_precomputed": (
        lambda s, d: monthly_bars(s, d).select("timestamp").distinct().join(scored(s, d).groupBy("timestamp").agg(F.count("*").alias("n")), "timestamp", "left").agg(F.count("*").alias("frames"), F.count_if(F.col("n").isNull()).alias("missing"), F.sum(F.coalesce("n", F.lit(0))).alias("predictions")),
        f"WITH {SCORED}, n AS (SELECT timestamp, count(*) AS n FROM scored GROUP BY 1) SELECT count(*) AS frames, count(*) FILTER (n IS NULL) AS missing, CAST(sum(coalesce(n, 0)) AS BIGINT) AS predictions FROM (SELECT DISTINCT timestamp FROM bars) LEFT JOIN n USING (timestamp)",
    ),
    "join_row_index": (
        lambda s, d: M.with_index(scored(s, d)).groupBy("t").agg(F.count("*").alias("n")),
        f"WITH {SCORED} SELECT CAST(dense_rank() OVER (ORDER BY timestamp) AS INTEGER) AS t, n FROM (SELECT timestamp, count(*) AS n FROM scored GROUP BY 1)",
    ),
    "join_paired_windows": (
        lambda s, d: _paired(s, d).agg(F.count("*").alias("n")),
        f"WITH {SCORED} SELECT count(*) AS n FROM (SELECT timestamp FROM scored GROUP BY 1)",
    ),
    "join_three_way_recon": (
        _reconcile,
        "WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), l AS (SELECT k, k % 50 AS q FROM f WHERE k % 3 <> 0 AND k IN (SELECT o_orderkey FROM orders)), m AS (SELECT k, CASE WHEN k % 7 = 0 THEN k % 49 ELSE k % 50 END AS q FROM f WHERE k % 5 <> 0) SELECT CASE WHEN m.q IS NULL THEN 'LOCAL_UNKNOWN' WHEN l.q IS NULL THEN 'REMOTE_UNKNOWN' WHEN l.q = m.q THEN 'MATCHED' ELSE 'RECOVERED' END AS status, count(*) AS n FROM l FULL JOIN m ON l.k = m.k GROUP BY 1",
    ),
    "join_symbol_dense_id": (lambda s, d: T.dense_ids(monthly_bars(s, d)), f"WITH {BARS} SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM bars)"),
    "join_merge_runs": (
        lambda s, d: T.keep_last(monthly_bars(s, d), ["symbol"], "timestamp").select("symbol", "timestamp", "close"),
        f"WITH {BARS} SELECT symbol, max(timestamp) AS timestamp, arg_max(close, timestamp) AS close FROM bars GROUP BY 1",
    ),
}
