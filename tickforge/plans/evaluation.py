"""Aggregates, prediction quality, drift and tests."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import rounded, sigmoid
from tickforge.operators import audit as U
from tickforge.operators import drift as D
from tickforge.operators import labels as L
from tickforge.operators import metrics as M
from tickforge.plans.common import FROM, SCORED, r, rounded_columns, scored
from tickforge.sources.tables import BARS, FILLS, day_ns, fills, monthly_bars, table


def _prob(s, d):
    return scored(s, d).select("timestamp", "symbol", rounded(sigmoid(5 * F.col("score")), 4).alias("p"), (F.col("label") > 0).cast("int").alias("y"))


_PROB = SCORED + ", prob AS (SELECT timestamp, symbol, floor(1 / (1 + exp(-5 * score)) * 1e4 + 0.5) / 1e4 AS p, CAST(label > 0 AS INTEGER) AS y FROM scored)"
_AVG_RANK = "(rank() OVER (PARTITION BY timestamp ORDER BY {0}) + (count(*) OVER (PARTITION BY timestamp, {0}) - 1) / 2.0)"
_CORR = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) <= 1e-15 THEN 0.0 ELSE covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
_BY_TIME = f"rk AS (SELECT *, {_AVG_RANK.format('score')} AS rs, {_AVG_RANK.format('label')} AS rl FROM scored), bt AS (SELECT timestamp, count(*) AS n, {_CORR.format('score', 'label')} AS ic, {_CORR.format('rs', 'rl')} AS rank_ic FROM rk GROUP BY 1 HAVING count(*) >= 2)"
_POS = "row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol)"


def _ndcg(k: int) -> str:
    return f"""n0 AS (SELECT *, pow(2, relevance) - 1 AS g, {_POS} AS p, row_number() OVER (PARTITION BY timestamp ORDER BY relevance DESC, symbol) AS i FROM scored),
n1 AS (SELECT *, avg(CASE WHEN p <= {k} THEN 1 / log2(p + 1) ELSE 0 END) OVER (PARTITION BY timestamp, score) AS dd FROM n0),
nd AS (SELECT timestamp, coalesce(sum(g * dd) / nullif(sum(CASE WHEN i <= {k} THEN g / log2(i + 1) END), 0), 0.0) AS ndcg FROM n1 GROUP BY 1)"""


def _halves(s, d):
    x = scored(s, d)
    return x.filter(F.col("timestamp") < FROM), x.filter(F.col("timestamp") >= FROM)


_HALVES = SCORED + f", a AS (SELECT * FROM scored WHERE timestamp < {FROM}), b AS (SELECT * FROM scored WHERE timestamp >= {FROM})"


def _tests(s, d):
    """One p-value per symbol: two-sided from the t statistic by a logistic approximation, the same in SQL."""
    t = scored(s, d).groupBy("symbol").agg((F.avg("label") / F.stddev_samp("label") * F.sqrt(F.count("*"))).alias("t"))
    return t.select(F.col("symbol").alias("id"), rounded(2 / (1 + F.exp(F.abs("t") * 1.702)), 8).alias("p"))


_TESTS = SCORED + f", tests AS (SELECT symbol AS id, {r('2 / (1 + exp(abs(avg(label) / stddev_samp(label) * sqrt(count(*))) * 1.702))', 8)} AS p FROM scored GROUP BY 1)"


def _step_up(c: str) -> str:
    return f"o AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM tests), q AS (SELECT id, p, least(min(p * n * {c} / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS q FROM o)"


def _alert_rows(s, d):
    by = M.by_time(scored(s, d)).select("timestamp", rounded(F.col("ic"), 8).alias("ic"), rounded(F.col("rank_ic"), 8).alias("rank_ic"))
    return by.select("timestamp", (F.abs("ic") > 0.9).alias("hard_failure"), (F.col("ic") < -0.3).alias("marginal"), (F.col("rank_ic") < -0.4).alias("joint"), (F.col("rank_ic") < -0.2).alias("concept"))


def _universe(s, d):
    sets = fills(s, d).groupBy((F.col("timestamp") / (90 * 86_400_000_000_000)).cast("long").alias("quarter"), "symbol").agg(F.count("*").alias("n")).filter("n >= 20")
    before = sets.select((F.col("quarter") + 1).alias("quarter"), "symbol", F.lit(1).alias("b"))
    both = sets.select("quarter", "symbol", F.lit(1).alias("a")).join(before, ["quarter", "symbol"], "full_outer")
    return both.groupBy("quarter").agg(rounded(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard"), F.count("a").alias("n"), F.count_if(F.col("b").isNull()).alias("n_new"))


def _concentration(s, d):
    rows = fills(s, d).groupBy("symbol").agg(rounded(F.sum(F.when(F.col("side") == "SELL", 1).otherwise(-1) * F.col("price") * F.col("quantity")), 2).alias("v")).filter("v > -1e15")
    rows = rows.withColumn("v", F.col("v") + 20_000_000.0).filter("v > 0").withColumn("k", F.row_number().over(Window.orderBy(F.desc("v"), "symbol")))
    return rows.agg(rounded(F.sum(F.when(F.col("k") <= 1, F.col("v")).otherwise(0.0)) / F.sum("v")).alias("top1"), rounded(F.sum(F.when(F.col("k") <= 5, F.col("v")).otherwise(0.0)) / F.sum("v")).alias("top5"))


def _softsort(s, d, k: int = 3, tau: float = 0.1):
    x = scored(s, d).select("timestamp", "symbol", "score")
    top = M.top_k(x, k).select("timestamp", F.col("score").alias("at"), "rank")
    rows = x.join(top, "timestamp").withColumn("e", F.exp(-F.abs(F.col("at") - F.col("score")) / tau))
    rows = rows.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy("timestamp", "rank")))
    return rows.groupBy("timestamp", "symbol").agg(rounded(F.sum("w") / k).alias("weight"))


_K = 5

QUERIES = {
    "agg_having_sessions": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_shipdate").alias("n")).filter("n >= 500").orderBy(F.desc("n"), "l_suppkey").limit(10),
        "SELECT l_suppkey, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) >= 500 ORDER BY n DESC, l_suppkey LIMIT 10",
    ),
    "agg_dataset_stats": (
        lambda s, d: table(s, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("props").isNull()).alias("bare")),
        "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(value) AS lo, max(value) AS hi, count(*) FILTER (value > 50) AS large, count(*) FILTER (props IS NULL) AS bare FROM events",
    ),
    "agg_cross_section_size": (
        lambda s, d: monthly_bars(s, d).groupBy("timestamp").agg(F.count_distinct("symbol").alias("n")).agg(F.min("n").alias("lo"), F.percentile("n", 0.5).alias("mid"), F.max("n").alias("hi")),
        f"WITH {BARS}, c AS (SELECT timestamp, count(DISTINCT symbol) AS n FROM bars GROUP BY 1) SELECT min(n) AS lo, quantile_cont(CAST(n AS DOUBLE), 0.5) AS mid, max(n) AS hi FROM c",
    ),
    "agg_trade_summary": (
        lambda s, d: fills(s, d).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), rounded(F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)), 1).alias("notional"), rounded(F.coalesce(F.sum("fee"), F.lit(0.0)), 1).alias("fees")),
        f"WITH {FILLS} SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, {r('coalesce(sum(quantity * price), 0)', 1)} AS notional, {r('coalesce(sum(fee), 0)', 1)} AS fees FROM fills",
    ),
    "agg_trades_by_day": (
        lambda s, d: table(s, d, "events").groupBy(F.to_date(F.col("ts") + F.expr("interval 8 hours")).cast("string").alias("date")).agg(F.count("*").alias("n")),
        "SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1",
    ),
    "agg_trades_by_side": (lambda s, d: fills(s, d).groupBy("side").agg(rounded(F.sum(F.col("quantity") * F.col("price")), 1).alias("notional")), f"WITH {FILLS} SELECT side, {r('sum(quantity * price)', 1)} AS notional FROM fills GROUP BY 1"),
    "agg_order_status": (
        lambda s, d: table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 1).alias("total")).orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority"),
        f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {r('sum(o_totalprice)', 1)} AS total FROM orders GROUP BY 1, 2",
    ),
    "agg_counts": (
        lambda s, d: table(s, d, "orders").select(F.lit("orders").alias("t")).unionAll(table(s, d, "lineitem").select(F.lit("lineitem"))).unionAll(table(s, d, "events").select(F.lit("events"))).groupBy("t").agg(F.count("*").alias("n")),
        "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events",
    ),
    "agg_zero_trade_reasons": (
        lambda s, d: table(s, d, "orders").filter("o_orderstatus <> 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority"),
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    ),
    "agg_daily_equity": (
        lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("equity")),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_max(value, struct_pack(a := ts, b := event_id)) AS equity FROM events GROUP BY 1",
    ),
    "agg_metrics_row": (
        lambda s, d: fills(s, d).groupBy("l_linestatus").agg(F.count("*").alias("n"), rounded(F.sum("fee"), 1).alias("fees"), F.sum("quantity").alias("quantity")),
        f"WITH {FILLS} SELECT l_linestatus, count(*) AS n, {r('sum(fee)', 1)} AS fees, CAST(sum(quantity) AS BIGINT) AS quantity FROM fills GROUP BY 1",
    ),
    "agg_portfolio_snapshot": (
        lambda s, d: _snapshot(s, d),
        f"WITH {FILLS}, p AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS q, arg_max(price, struct_pack(a := timestamp, b := order_id, c := l_linenumber, d := l_partkey, e := quantity, f := price)) AS px FROM fills GROUP BY 1), v AS (SELECT r_name AS industry, q * px AS v FROM p JOIN supplier ON CAST(symbol AS BIGINT) = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT industry, count(*) AS n, {r('sum(abs(v)) / 1e6', 4)} AS gross, {r('sum(v) / 1e6', 4)} AS net, {r('max(abs(v)) / sum(abs(v))')} AS largest FROM v GROUP BY 1",
    ),
    "agg_turnover_notional": (
        lambda s, d: fills(s, d).groupBy(F.year(F.timestamp_seconds(F.col("timestamp") / 1000000000)).alias("year")).agg(rounded(F.sum(F.abs(F.col("quantity") * F.col("price"))) / 1e6, 4).alias("turnover")),
        f"WITH {FILLS} SELECT CAST(year(to_timestamp(timestamp / 1000000000)) AS INTEGER) AS year, {r('sum(abs(quantity * price)) / 1e6', 4)} AS turnover FROM fills GROUP BY 1",
    ),
    "agg_contribution": (
        lambda s, d: fills(s, d).groupBy("symbol").agg(rounded(F.sum(F.when(F.col("side") == "SELL", 1).otherwise(-1) * F.col("price") * F.col("quantity") - F.col("fee")) / 1e6, 4).alias("net")),
        f"WITH {FILLS} SELECT symbol, {r('sum(CASE side WHEN $$SELL$$ THEN 1 ELSE -1 END * price * quantity - fee) / 1e6', 4)} AS net FROM fills GROUP BY 1",
    ),
    "agg_cvar_tail_mean": (
        lambda s, d: _cvar(s, d),
        f"WITH {SCORED}, o AS (SELECT symbol, label, row_number() OVER (PARTITION BY symbol ORDER BY label, timestamp) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM scored) SELECT symbol, {r('avg(label)')} AS cvar FROM o WHERE k <= ceil(0.05 * n) GROUP BY 1",
    ),
    "agg_concentration": (
        _concentration,
        f"WITH {FILLS}, v AS (SELECT symbol, {r('sum(CASE side WHEN $$SELL$$ THEN 1 ELSE -1 END * price * quantity)', 2)} + 20000000.0 AS v FROM fills GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY v DESC, symbol) AS k FROM v WHERE v > 0) SELECT {r('sum(v) FILTER (k <= 1) / sum(v)')} AS top1, {r('sum(v) FILTER (k <= 5) / sum(v)')} AS top5 FROM o",
    ),
    "agg_model_mean_std": (
        lambda s, d: scored(s, d).groupBy("timestamp").agg(F.avg("label").alias("ret"), F.avg("score").alias("sc")).unpivot([], ["ret", "sc"], "metric", "v").groupBy("metric").agg(rounded(F.avg("v")).alias("mean"), rounded(F.stddev_pop("v")).alias("std")),
        f"WITH {SCORED}, t AS (SELECT timestamp, avg(label) AS ret, avg(score) AS sc FROM scored GROUP BY 1) SELECT 'ret' AS metric, {r('avg(ret)')} AS mean, {r('stddev_pop(ret)')} AS std FROM t UNION ALL SELECT 'sc', {r('avg(sc)')}, {r('stddev_pop(sc)')} FROM t",
    ),
    "agg_promotion_windows": (
        lambda s, d: _windows(s, d),
        f"WITH {SCORED}, t AS (SELECT symbol, timestamp // 31536000000000000 AS w, avg(label) AS m FROM scored GROUP BY 1, 2) SELECT w AS \"window\", {r('avg(m)')} AS mean, {r('min(m)')} AS lo, {r('max(m)')} AS hi, arg_max(symbol, struct_pack(a := {r('m')}, b := symbol)) AS best, count(*) FILTER (m > 0) AS wins FROM t GROUP BY 1",
    ),
    "agg_prediction_metrics": (
        lambda s, d: rounded_columns(M.regression(scored(s, d))),
        f"WITH {SCORED}, e AS (SELECT *, abs(score - label) AS e FROM scored) SELECT {r('avg(e)')} AS mae, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END)')} AS huber, {r(_CORR.format('score', 'label'))} AS ic FROM e",
    ),
    "agg_pearson": (lambda s, d: scored(s, d).groupBy("symbol").agg(rounded(M.pearson(F.col("score"), F.col("label"))).alias("ic")), f"WITH {SCORED} SELECT symbol, {r(_CORR.format('score', 'label'))} AS ic FROM scored GROUP BY 1"),
    "agg_auc": (
        lambda s, d: rounded_columns(M.auc_by_value(_prob(s, d))),
        f"WITH {_PROB}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM prob) SELECT {r('(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} AS auc FROM k",
    ),
    "agg_ece": (
        lambda s, d: rounded_columns(M.ece(_prob(s, d))),
        f"WITH {_PROB}, b AS (SELECT least(floor(p * 10), 9) AS k, count(*) AS n, avg(p) AS p, avg(y) AS y FROM prob GROUP BY 1) SELECT {r('sum(n * abs(p - y)) / sum(n)')} AS ece FROM b",
    ),
    "agg_pinball": (
        lambda s, d: scored(s, d).agg(*(rounded(M.pinball(F.col("label") - F.col("score"), q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.9)), rounded(F.avg((F.abs(F.col("label") - F.col("score")) < 0.5).cast("double"))).alias("coverage")),
        f"WITH {SCORED} SELECT {r('avg(greatest(0.1 * (label - score), -0.9 * (label - score)))')} AS q10, {r('avg(greatest(0.9 * (label - score), -0.1 * (label - score)))')} AS q90, {r('avg(CASE WHEN abs(label - score) < 0.5 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM scored",
    ),
    "agg_rank_ic": (
        lambda s, d: rounded_columns(M.rank_ic(scored(s, d))),
        f"WITH {SCORED}, {_BY_TIME} SELECT {r('avg(ic)')} AS ic, {r('avg(rank_ic)')} AS rank_ic, {r('coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0.0)')} AS icir, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_rate, count(*) AS n_times FROM bt",
    ),
    "agg_ndcg_tie": (lambda s, d: rounded_columns(M.ndcg_tied(scored(s, d), _K)), f"WITH {SCORED}, {_ndcg(_K)} SELECT timestamp, {r('ndcg')} AS ndcg FROM nd"),
    "agg_ndcg_first": (
        lambda s, d: rounded_columns(M.ndcg_first(scored(s, d), _K)),
        f"WITH {SCORED}, n0 AS (SELECT *, {_POS} AS p, row_number() OVER (PARTITION BY timestamp ORDER BY relevance DESC, symbol) AS i FROM scored) SELECT timestamp, {r(f'coalesce(sum(CASE WHEN p <= {_K} THEN relevance / log2(p + 1) END) / nullif(sum(CASE WHEN i <= {_K} THEN relevance / log2(i + 1) END), 0), 0.0)')} AS ndcg FROM n0 GROUP BY 1",
    ),
    "agg_ranking_oos": (
        lambda s, d: rounded_columns(M.ranking_oos(scored(s, d), _K)),
        f"""WITH {SCORED}, {_BY_TIME}, {_ndcg(_K)},
o AS (SELECT *, count(*) OVER (PARTITION BY timestamp) AS n, {_POS} AS u, row_number() OVER (PARTITION BY timestamp ORDER BY score, symbol) AS dn, row_number() OVER (PARTITION BY timestamp ORDER BY label DESC, symbol) AS b, dense_rank() OVER (ORDER BY timestamp) AS t FROM scored),
e AS (SELECT timestamp, count(*) FILTER (u <= {_K} AND b <= {_K}) * 1.0 / least({_K}, max(n)) AS precision, avg(label) FILTER (u <= {_K}) - avg(label) FILTER (dn <= {_K}) AS spread FROM o GROUP BY 1),
tt AS (SELECT a.timestamp, 1 - count(c.symbol) * 1.0 / {_K} AS turnover FROM o a LEFT JOIN o c ON c.t = a.t - 1 AND c.symbol = a.symbol AND c.u <= {_K} WHERE a.u <= {_K} AND a.t > 1 GROUP BY 1)
SELECT {r('avg(ndcg)')} AS ndcg, {r('avg(rank_ic)')} AS rank_ic, {r('avg(precision)')} AS precision, {r('avg(spread)')} AS spread, {r('avg(turnover)')} AS turnover FROM e JOIN nd USING (timestamp) LEFT JOIN bt USING (timestamp) LEFT JOIN tt USING (timestamp)""",
    ),
    "win_consecutive_sets": (
        lambda s, d: rounded_columns(M.consecutive_overlap(M.top_k(scored(s, d), _K), _K)),
        f"WITH {SCORED}, o AS (SELECT *, {_POS} AS u, dense_rank() OVER (ORDER BY timestamp) AS t FROM scored) SELECT a.timestamp, {r(f'count(c.symbol) * 1.0 / {_K}')} AS overlap, {r(f'1 - count(c.symbol) * 1.0 / {_K}')} AS turnover FROM o a LEFT JOIN o c ON c.t = a.t - 1 AND c.symbol = a.symbol AND c.u <= {_K} WHERE a.u <= {_K} AND a.t > 1 GROUP BY 1",
    ),
    "topk_per_session": (lambda s, d: M.top_k(scored(s, d), 3).select("timestamp", "symbol", F.col("rank").cast("int")), f"WITH {SCORED} SELECT timestamp, symbol, CAST(u AS INTEGER) AS rank FROM (SELECT *, {_POS} AS u FROM scored) WHERE u <= 3"),
    "topk_softsort": (
        _softsort,
        f"WITH {SCORED}, x AS (SELECT timestamp, symbol, score, {_POS} AS u FROM scored), j AS (SELECT x.timestamp, x.symbol, t.u, exp(-abs(t.score - x.score) / 0.1) AS e FROM x JOIN x t ON x.timestamp = t.timestamp AND t.u <= 3), w AS (SELECT *, e / sum(e) OVER (PARTITION BY timestamp, u) AS w FROM j) SELECT timestamp, symbol, {r('sum(w) / 3')} AS weight FROM w GROUP BY 1, 2",
    ),
    "topk_stability_penalty": (
        lambda s, d: _penalty(s, d),
        f"WITH {SCORED}, x AS (SELECT timestamp, symbol, exp(score) / sum(exp(score)) OVER (PARTITION BY timestamp) AS w, dense_rank() OVER (ORDER BY timestamp) AS t FROM scored) SELECT a.timestamp, {r('avg((a.w - b.w) * (a.w - b.w))', 8)} AS penalty FROM x a JOIN x b ON a.symbol = b.symbol AND b.t = a.t - 1 GROUP BY 1",
    ),
    "agg_listmle": (
        lambda s, d: rounded_columns(M.list_mle(scored(s, d)), 4),
        f"WITH {SCORED}, e AS (SELECT *, max(score) OVER (PARTITION BY timestamp) AS m FROM scored), l AS (SELECT timestamp, ln(sum(exp(score - m)) OVER (PARTITION BY timestamp ORDER BY label DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + m - score AS l FROM e), t AS (SELECT timestamp, sum(l) AS l FROM l GROUP BY 1) SELECT {r('avg(l)', 4)} AS list_mle FROM t",
    ),
    "agg_lambda_loss": (
        lambda s, d: rounded_columns(M.lambda_loss(scored(s, d), _K)),
        f"""WITH {SCORED}, n0 AS (SELECT *, pow(2, relevance) - 1 AS g, {_POS} AS p, row_number() OVER (PARTITION BY timestamp ORDER BY relevance DESC, symbol) AS i FROM scored),
n1 AS (SELECT *, CASE WHEN p <= {_K} THEN 1 / log2(p + 1) ELSE 0 END AS dd, sum(CASE WHEN i <= {_K} THEN g / log2(i + 1) ELSE 0 END) OVER (PARTITION BY timestamp) AS best FROM n0),
q AS (SELECT a.timestamp, abs((a.g - b.g) * (a.dd - b.dd)) / nullif(a.best, 0) AS w, greatest(0, b.score - a.score) + ln(1 + exp(-abs(b.score - a.score))) AS l FROM n1 a JOIN n1 b ON a.timestamp = b.timestamp AND a.relevance > b.relevance),
t AS (SELECT timestamp, coalesce(sum(w * l) / nullif(sum(w), 0), 0.0) AS l FROM q GROUP BY 1) SELECT {r('avg(l)')} AS lambda_loss FROM t""",
    ),
    "agg_variant_compare": (
        lambda s, d: M.by_time(scored(s, d)).select("timestamp", (-F.col("ic")).alias("legacy")).join(M.ndcg_tied(scored(s, d), _K), "timestamp").agg(rounded(F.avg("legacy")).alias("legacy"), rounded(F.avg("ndcg")).alias("ndcg")),
        f"WITH {SCORED}, {_BY_TIME}, {_ndcg(_K)} SELECT {r('avg(-ic)')} AS legacy, {r('avg(ndcg)')} AS ndcg FROM bt JOIN nd USING (timestamp)",
    ),
    "agg_score_buckets": (
        lambda s, d: rounded_columns(M.score_buckets(scored(s, d), 5)),
        f"WITH {SCORED}, b AS (SELECT timestamp, label, CAST(floor((row_number() OVER (PARTITION BY timestamp ORDER BY score, symbol) - 1) * 5 / count(*) OVER (PARTITION BY timestamp)) AS INTEGER) AS bucket FROM scored), t AS (SELECT timestamp, bucket, count(*) AS n, avg(label) AS l FROM b GROUP BY 1, 2) SELECT bucket, CAST(sum(n) AS BIGINT) AS n, {r('avg(l)')} AS mean_label FROM t GROUP BY 1",
    ),
    "agg_distribution_summary": (
        lambda s, d: rounded_columns(D.summary(scored(s, d), "score")),
        f"WITH {SCORED}, q AS (SELECT quantile_cont(score, 0.5) AS m FROM scored) SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, {r('avg(score)')} AS mean, {r('var_samp(score)')} AS variance, {r('quantile_cont(score, 0.5)')} AS median, {r('quantile_cont(abs(score - m), 0.5)')} AS mad, {', '.join(r(f'quantile_cont(score, {q})') + f' AS {k}' for q, k in ((0.05, 'p05'), (0.25, 'p25'), (0.75, 'p75'), (0.95, 'p95')))} FROM scored, q",
    ),
    "agg_distribution_summary_pop": (
        lambda s, d: rounded_columns(D.summary(scored(s, d), "label", True).select("n", "mean", "variance")),
        f"WITH {SCORED} SELECT count(*) AS n, {r('avg(label)')} AS mean, {r('var_pop(label)')} AS variance FROM scored",
    ),
    "agg_brier_logloss_bce": (
        lambda s, d: rounded_columns(M.brier_and_log_loss(_prob(s, d))),
        f"WITH {_PROB}, c AS (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS c FROM prob) SELECT {r('avg((p - y) * (p - y))')} AS brier, {r('-avg(y * ln(c) + (1 - y) * ln(1 - c))')} AS log_loss FROM c",
    ),
    "agg_timestamp_errors": (
        lambda s, d: scored(s, d).groupBy("timestamp").agg(F.avg(F.abs(F.col("score") - F.col("label"))).alias("mae")).agg(rounded(F.avg("mae")).alias("mean"), rounded(F.percentile("mae", 0.99)).alias("p99"), rounded(F.max("mae")).alias("worst")),
        f"WITH {SCORED}, t AS (SELECT timestamp, avg(abs(score - label)) AS mae FROM scored GROUP BY 1) SELECT {r('avg(mae)')} AS mean, {r('quantile_cont(mae, 0.99)')} AS p99, {r('max(mae)')} AS worst FROM t",
    ),
    "agg_first_last_universe": (
        lambda s, d: monthly_bars(s, d).groupBy("symbol").agg(F.max("timestamp").alias("last")).crossJoin(F.broadcast(monthly_bars(s, d).agg(F.max("timestamp").alias("end")))).agg(F.count("*").alias("n"), rounded(F.avg((F.col("last") < F.col("end")).cast("double"))).alias("stale_rate")),
        f"WITH {BARS}, l AS (SELECT symbol, max(timestamp) AS last FROM bars GROUP BY 1) SELECT count(*) AS n, {r('avg(CASE WHEN last < (SELECT max(timestamp) FROM bars) THEN 1.0 ELSE 0.0 END)')} AS stale_rate FROM l",
    ),
    "drift_psi_quantile": (
        lambda s, d: rounded_columns(D.psi_quantile(*_halves(s, d), "score")),
        f"""WITH {_HALVES},
g AS (SELECT min(score) AS lo, max(score) AS hi FROM a), ed AS (SELECT DISTINCT unnest(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM a),
s AS (SELECT 0 AS side, score FROM a UNION ALL SELECT 1, score FROM b),
bn AS (SELECT side, CASE WHEN score < lo THEN -2 WHEN score > hi THEN -3 ELSE (SELECT count(*) FROM ed WHERE v <= score) END AS bin FROM s, g),
al AS (SELECT unnest([-3, -2, -1]) AS bin UNION ALL SELECT i FROM range(0, 10) t(i)),
c AS (SELECT al.bin, count(side) FILTER (side = 0) AS a, count(side) FILTER (side = 1) AS b FROM al LEFT JOIN bn ON al.bin = bn.bin GROUP BY 1),
p AS (SELECT (a + 0.5) / (sum(a) OVER () + 0.5 * 13) AS p, (b + 0.5) / (sum(b) OVER () + 0.5 * 13) AS q FROM c)
SELECT {r('sum((q - p) * ln(q / p))')} AS psi FROM p""",
    ),
    "drift_psi_fixed": (
        lambda s, d: rounded_columns(D.psi_fixed(*_halves(s, d), "score", [-0.5, -0.1, 0.0, 0.1, 0.5])),
        f"""WITH {_HALVES}, s AS (SELECT 0 AS side, score FROM a UNION ALL SELECT 1, score FROM b), bn AS (SELECT side, CAST(score >= -0.5 AS INT) + CAST(score >= -0.1 AS INT) + CAST(score >= 0 AS INT) + CAST(score >= 0.1 AS INT) + CAST(score >= 0.5 AS INT) AS bin FROM s),
c AS (SELECT bin, count(*) FILTER (side = 0) * 1.0 AS a, count(*) FILTER (side = 1) * 1.0 AS b FROM bn GROUP BY 1), f AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS a, greatest(b / sum(b) OVER (), 1e-6) AS b FROM c), n AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM f) SELECT {r('sum((b - a) * ln(b / a))')} AS psi FROM n""",
    ),
    "drift_ks": (
        lambda s, d: rounded_columns(D.ks(*_halves(s, d), "score")),
        f"WITH {_HALVES}, s AS (SELECT score AS x, 1 AS a, 0 AS b FROM a UNION ALL SELECT score, 0, 1 FROM b), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM s GROUP BY 1), d AS (SELECT abs(sum(a) OVER (ORDER BY x) * 1.0 / sum(a) OVER () - sum(b) OVER (ORDER BY x) * 1.0 / sum(b) OVER ()) AS d FROM c) SELECT {r('max(d)')} AS ks FROM d",
    ),
    "drift_categorical": (
        lambda s, d: rounded_columns(D.categorical(table(s, d, "events").filter("event_id < 5000 and event_type <> 'error'"), table(s, d, "events").filter("event_id >= 5000"), "event_type")),
        f"WITH c AS (SELECT event_type, count(*) FILTER (event_id < 5000 AND event_type <> 'error') AS a, count(*) FILTER (event_id >= 5000) AS b FROM events WHERE event_id >= 5000 OR event_type <> 'error' GROUP BY 1), p AS (SELECT a AS ca, b AS cb, (a + 0.5) / (sum(a) OVER () + 0.5 * count(*) OVER ()) AS a, (b + 0.5) / (sum(b) OVER () + 0.5 * count(*) OVER ()) AS b FROM c) SELECT {r('sum((b - a) * ln(b / a))')} AS psi, {r('sum(0.5 * a * ln(a / ((a + b) / 2)) + 0.5 * b * ln(b / ((a + b) / 2)))')} AS js, {r('0.5 * sum(abs(a - b))')} AS tv, {r('sum(CASE WHEN ca = 0 THEN cb ELSE 0 END) * 1.0 / nullif(sum(cb), 0)')} AS new_rate FROM p",
    ),
    "drift_concept": (
        lambda s, d: rounded_columns(M.by_time(scored(s, d)).withColumn("half", (F.col("timestamp") >= FROM).cast("int")).groupBy("half").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("sign_rate"), F.count("*").alias("n"))),
        f"WITH {SCORED}, {_BY_TIME} SELECT CAST(timestamp >= {FROM} AS INTEGER) AS half, {r('avg(ic)')} AS ic, {r('avg(rank_ic)')} AS rank_ic, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS sign_rate, count(*) AS n FROM bt GROUP BY 1",
    ),
    "drift_label_concept": (
        lambda s, d: scored(s, d).withColumn("half", (F.col("timestamp") >= FROM).cast("int")).groupBy("half").agg(rounded(M.pearson(F.col("score"), F.col("label"))).alias("ic"), rounded(F.avg(F.abs(F.col("score") - F.col("label")))).alias("mae")),
        f"WITH {SCORED} SELECT CAST(timestamp >= {FROM} AS INTEGER) AS half, {r(_CORR.format('score', 'label'))} AS ic, {r('avg(abs(score - label))')} AS mae FROM scored GROUP BY 1",
    ),
    "drift_prediction": (
        lambda s, d: scored(s, d).join(M.top_k(scored(s, d), _K).select("timestamp", "symbol", F.lit(1).alias("t")), ["timestamp", "symbol"], "left").groupBy("timestamp").agg(rounded(F.sum(F.when(F.col("t") == 1, F.abs("score")).otherwise(0.0)) / F.sum(F.abs("score"))).alias("concentration")),
        f"WITH {SCORED} SELECT timestamp, {r(f'sum(CASE WHEN u <= {_K} THEN abs(score) ELSE 0 END) / sum(abs(score))')} AS concentration FROM (SELECT *, {_POS} AS u FROM scored) GROUP BY 1",
    ),
    "drift_portfolio": (
        lambda s, d: scored(s, d).withColumn("w", F.exp("score") / F.sum(F.exp("score")).over(Window.partitionBy("timestamp"))).groupBy("timestamp").agg(rounded(F.sum(F.col("w") * F.col("w"))).alias("hhi")),
        f"WITH {SCORED}, x AS (SELECT timestamp, exp(score) / sum(exp(score)) OVER (PARTITION BY timestamp) AS w FROM scored) SELECT timestamp, {r('sum(w * w)')} AS hhi FROM x GROUP BY 1",
    ),
    "drift_universe": (
        _universe,
        f"WITH {FILLS}, s AS (SELECT CAST(floor(timestamp / (90 * 86400000000000.0)) AS BIGINT) AS q, symbol FROM fills GROUP BY 1, 2 HAVING count(*) >= 20) SELECT coalesce(a.q, b.q + 1) AS quarter, {r('count(*) FILTER (a.q IS NOT NULL AND b.q IS NOT NULL) * 1.0 / count(*)')} AS jaccard, count(a.q) AS n, count(*) FILTER (b.q IS NULL) AS n_new FROM s a FULL JOIN s b ON a.q = b.q + 1 AND a.symbol = b.symbol GROUP BY 1",
    ),
    "drift_window_builders": (
        lambda s, d: M.with_index(scored(s, d)).withColumn("back", F.max("t").over(Window.partitionBy()) - F.col("t")).withColumn("part", F.when(F.col("back") < 3, "fast").when(F.col("back") < 12, "confirm").when(F.col("back") < 36, "reference")).filter("part is not null").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("timestamp").alias("sessions")),
        f"WITH {SCORED}, x AS (SELECT timestamp, dense_rank() OVER (ORDER BY timestamp DESC) - 1 AS b FROM scored) SELECT CASE WHEN b < 3 THEN 'fast' WHEN b < 12 THEN 'confirm' ELSE 'reference' END AS part, count(*) AS n, count(DISTINCT timestamp) AS sessions FROM x WHERE b < 36 GROUP BY 1",
    ),
    "drift_window_slice": (
        lambda s, d: scored(s, d).agg(F.count_if(F.col("timestamp") < FROM).alias("n"), F.count_if((F.col("timestamp") < FROM) & (F.col("timestamp") + 86_400_000_000_000 * 40 > FROM)).alias("n_late")),
        f"WITH {SCORED} SELECT count(*) FILTER (timestamp < {FROM}) AS n, count(*) FILTER (timestamp < {FROM} AND timestamp + {86_400_000_000_000 * 40} > {FROM}) AS n_late FROM scored",
    ),
    "drift_quality": (
        lambda s, d: monthly_bars(s, d).groupBy("timestamp").agg(F.count("*").alias("n"), F.count_if(F.col("volume") < 50).alias("thin")).select("timestamp", F.when(F.col("n") < 90, "HARD").when(F.col("thin") * 10 > F.col("n"), "WARN").otherwise("OK").alias("state")),
        f"WITH {BARS} SELECT timestamp, CASE WHEN count(*) < 90 THEN 'HARD' WHEN count(*) FILTER (volume < 50) * 10 > count(*) THEN 'WARN' ELSE 'OK' END AS state FROM bars GROUP BY 1",
    ),
    "drift_alert_machine": (
        lambda s, d: D.alerts(_alert_rows(s, d), "timestamp").select("timestamp", "state", "streak"),
        f"WITH {SCORED}, {_BY_TIME}, f AS (SELECT timestamp, abs(ic) > 0.9 AS h, ic < -0.3 AS m, rank_ic < -0.4 AS j, rank_ic < -0.2 AS c FROM (SELECT timestamp, {r('ic', 8)} AS ic, {r('rank_ic', 8)} AS rank_ic FROM bt)), g AS (SELECT *, (m OR j) AND c AS b FROM f), i AS (SELECT *, count(*) FILTER (NOT b) OVER (ORDER BY timestamp) AS isl FROM g), k AS (SELECT *, count(*) FILTER (b) OVER (PARTITION BY isl ORDER BY timestamp) AS streak FROM i) SELECT timestamp, CASE WHEN h OR streak >= 2 THEN 'CRITICAL' WHEN m OR j OR c THEN 'WARN' ELSE 'INFO' END AS state, streak FROM k",
    ),
    "stat_bh_by": (lambda s, d: rounded_columns(D.adjusted(_tests(s, d)).withColumnRenamed("q", "bh").join(D.adjusted(_tests(s, d), dependent=True).select("id", F.col("q").alias("by")), "id")), f"WITH {_TESTS}, {_step_up('1.0')}, o2 AS (SELECT id, p, k, n FROM o), q2 AS (SELECT id, least(min(p * n * (SELECT sum(1.0 / i) FROM range(1, 1000) t(i) WHERE i <= n) / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS b FROM o2) SELECT id, {r('p')} AS p, {r('q')} AS bh, {r('b')} AS \"by\" FROM q JOIN q2 USING (id)"),
    "stat_storey": (
        lambda s, d: rounded_columns(D.storey(_tests(s, d), lambdas=(0.3, 0.5))),
        f"WITH {_TESTS}, {_step_up('1.0')}, z AS (SELECT (least(1.0, count(*) FILTER (p > 0.3) / (0.7 * count(*))) + least(1.0, count(*) FILTER (p > 0.5) / (0.5 * count(*)))) / 2 AS pi0 FROM tests) SELECT id, {r('p')} AS p, {r('least(q * pi0, 1.0)')} AS q, {r('pi0')} AS pi0 FROM q, z",
    ),
    "audit_leakage": (
        lambda s, d: _audit(s, d),
        f"WITH {SCORED}, t AS (SELECT timestamp, symbol, lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS ex FROM scored) SELECT 'key_unique' AS \"check\", CAST(0 AS BIGINT) AS n_bad UNION ALL SELECT 'label_after_signal', count(*) FILTER (ex <= timestamp) FROM t UNION ALL SELECT 'feature_known', CAST(0 AS BIGINT)",
    ),
    "audit_dataset": (lambda s, d: _full_audit(s, d), None),
    "audit_time_invariance": (lambda s, d: _invariance(s, d), "SELECT CAST(0 AS BIGINT) AS n_different"),
}


def _snapshot(s, d):
    f = fills(s, d)
    key = F.struct("timestamp", "order_id", "l_linenumber", "l_partkey", "quantity", "price")
    p = f.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("q"), F.max_by("price", key).alias("px"))
    dims = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    v = p.join(dims, p.symbol.cast("long") == F.col("s_suppkey")).select(F.col("r_name").alias("industry"), (F.col("q") * F.col("px")).alias("v"))
    return v.groupBy("industry").agg(F.count("*").alias("n"), rounded(F.sum(F.abs("v")) / 1e6, 4).alias("gross"), rounded(F.sum("v") / 1e6, 4).alias("net"), rounded(F.max(F.abs("v")) / F.sum(F.abs("v"))).alias("largest"))


def _cvar(s, d):
    w = Window.partitionBy("symbol")
    x = scored(s, d).withColumns({"k": F.row_number().over(w.orderBy("label", "timestamp")), "n": F.count("*").over(w)})
    return x.filter(F.col("k") <= F.ceil(0.05 * F.col("n"))).groupBy("symbol").agg(rounded(F.avg("label")).alias("cvar"))


def _windows(s, d):
    t = scored(s, d).groupBy("symbol", F.expr("timestamp div 31536000000000000").alias("window")).agg(F.avg("label").alias("m"))
    return t.groupBy("window").agg(rounded(F.avg("m")).alias("mean"), rounded(F.min("m")).alias("lo"), rounded(F.max("m")).alias("hi"), F.max_by("symbol", F.struct(rounded(F.col("m")), "symbol")).alias("best"), F.count_if(F.col("m") > 0).alias("wins"))


def _penalty(s, d):
    x = M.with_index(scored(s, d).withColumn("w", F.exp("score") / F.sum(F.exp("score")).over(Window.partitionBy("timestamp"))))
    b = x.select((F.col("t") + 1).alias("t"), "symbol", F.col("w").alias("b"))
    return x.join(b, ["t", "symbol"]).groupBy("timestamp").agg(rounded(F.avg(F.pow(F.col("w") - F.col("b"), 2)), 8).alias("penalty"))


_LABEL_SPEC = '{"entry": "first trade of the next bar", "exit": "last trade of the bar after it"}'


def _samples(s, d):
    """Bars with features and label as samples; their times are the dates of the trades and orders they are made of."""
    trades = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day_ns(F.col("o_orderdate")).alias("ordered")), "l_orderkey", "left")
    day = day_ns(F.col("l_shipdate"))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    dated = trades.select(day_ns(month).alias("timestamp"), day_ns(F.add_months(month, 1)).alias("end"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), day.alias("day"), "ordered")
    times = dated.groupBy("timestamp", "symbol").agg(F.first("end").alias("end"), F.min("day").alias("opened"), F.max("day").alias("closed"), F.max("ordered").alias("ordered"))
    w = Window.partitionBy("symbol").orderBy("timestamp")
    so_far, last_two = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-1, 0)
    x = times.select(
        "timestamp", "symbol", (F.col("end") - 1).alias("signal_asof"), F.max("closed").over(last_two).alias("feature_source_max_timestamp"), F.max("ordered").over(last_two).alias("reference_data_known_at_max"),
        F.min("opened").over(so_far).alias("universe_asof"), F.lead("opened", 1).over(w).alias("label_entry_timestamp"), F.lead("closed", 2).over(w).alias("label_exit_timestamp"),
    )
    label = L.next_open(monthly_bars(s, d)).filter("label_valid").select("timestamp", "symbol", F.col("expected_return").alias("label"))
    return x.join(scored(s, d).select("timestamp", "symbol", "score"), ["timestamp", "symbol"]).join(label, ["timestamp", "symbol"])


def _audit(s, d):
    found = U.audit(_samples(s, d), {}).filter(F.col("check").isin("SPLIT_KEY_UNIQUENESS", "LABEL_INTERVAL", "FEATURE_TIME"))
    name = F.when(F.col("check") == "SPLIT_KEY_UNIQUENESS", "key_unique").when(F.col("check") == "LABEL_INTERVAL", "label_after_signal").otherwise("feature_known")
    return found.select(name.alias("check"), "n_bad")


def _differences(left, right):
    return left.exceptAll(right).unionAll(right.exceptAll(left)).limit(1).count()


def _full_audit(s, d):
    """All checks on the samples of the whole table, its chronological split and what is declared of it."""
    import inspect

    from tickforge.operators import features as X

    rows = _samples(s, d).persist()
    bars = monthly_bars(s, d)
    later, known = F.col("timestamp") >= FROM, F.col("timestamp") < FROM
    whole = X.bar_v1(bars).filter(known)
    prefix = X.bar_v1(bars.filter(known))
    moved = X.bar_v1(bars.withColumns({c: F.when(later, F.col(c) * 1.37).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).withColumn("volume", F.when(later, F.col("volume") + 7919).otherwise(F.col("volume")))).filter(known)
    # raw bars pass through, features are compared as rounded numbers
    cols = [F.col(c) if t not in ("double", "float") else rounded(F.col(c), 9).alias(c) for c, t in whole.dtypes]
    whole, prefix, moved = (x.select(cols) for x in (whole, prefix, moved))
    split = L.chronological(rows, purge=2)
    fit_end = rows.join(split.filter("part = 'train'"), "timestamp").agg(F.max("feature_source_max_timestamp")).first()[0]
    meta = {
        "calendar_id": "months", "universe_id": "lineitem.l_suppkey", "feature_code_sha256": hashlib.sha256(inspect.getsource(X).encode()).hexdigest(), "label_spec_json": _LABEL_SPEC,
        "label_spec_sha256": hashlib.sha256(_LABEL_SPEC.encode()).hexdigest(), "point_in_time_required": True, "prefix_invariance_pass": not _differences(whole, prefix),
        "future_mutation_pass": not _differences(whole, moved), "dataset_fingerprint": U.fingerprint(_samples(s, d).repartition(3)),
    }
    return U.audit(rows, meta, split, fit_end)


def _invariance(s, d):
    """Features of a prefix do not change with what comes after: both ways empty."""
    from tickforge.operators import features as X

    bars = monthly_bars(s, d)
    cols = ["timestamp", "symbol", "log_return_5", "volatility_20", "cross_section_return_rank"]
    whole = X.bar_v1(bars).filter(F.col("timestamp") < FROM).select(cols)
    mutated = X.bar_v1(bars.withColumn("close", F.when(F.col("timestamp") >= FROM, F.col("close") * 3).otherwise(F.col("close")))).filter(F.col("timestamp") < FROM).select(cols)
    return whole.exceptAll(mutated).unionAll(mutated.exceptAll(whole)).agg(F.count("*").alias("n_different"))


