"""Windows, features, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import average_rank, full, percent_rank_average, ratio, rounded
from tickforge.operators import features as X
from tickforge.operators import labels as L
from tickforge.operators.features import by_symbol
from tickforge.plans.common import FROM, SCORED, r, rounded_columns, scored
from tickforge.sources.tables import BARS, monthly_bars

_W = "OVER (PARTITION BY symbol ORDER BY timestamp)"


def _rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, e: str) -> str:
    return f"CASE WHEN count({x}) {_rows(n)} = {n} THEN {e} END"


def _std(x: str, n: int) -> str:
    return _full(x, n, f"stddev_pop({x}) {_rows(n)}")


def _ma(n: int) -> str:
    return _full("close", n, f"ln(close) - ln(avg(close) {_rows(n)})")


def one(column: str, expression, sql: str):
    """A query of one window column over the bars, rounded."""
    return (
        lambda s, d: monthly_bars(s, d).withColumn("r1", F.ln("close") - F.ln(F.lag("close").over(by_symbol()))).select("timestamp", "symbol", rounded(expression()).alias(column)),
        f"WITH {BARS}, x AS (SELECT *, ln(close) - ln(lag(close) {_W}) AS r1 FROM bars) SELECT timestamp, symbol, {r(sql)} AS {column} FROM x",
    )


_RANK = "CASE WHEN r1 IS NOT NULL THEN (rank() OVER (PARTITION BY timestamp ORDER BY r1 NULLS LAST) + (count(*) OVER (PARTITION BY timestamp, r1) - 1) / 2.0) / count(r1) OVER (PARTITION BY timestamp) END"

_V1 = f"""
{BARS},
x AS (SELECT *, ln(close) - ln(lag(close) {_W}) AS r1, ln(1 + CAST(volume AS DOUBLE)) AS lv FROM bars),
f AS (SELECT timestamp, symbol, r1 AS log_return_1,
  {", ".join(f"ln(close) - ln(lag(close, {k}) {_W}) AS log_return_{k}" for k in (5, 10, 20))},
  ln(high) - ln(low) AS intraday_range, ln(close) - ln(open) AS close_open_return, ln(open) - ln(lag(close) {_W}) AS overnight_gap, lv AS log_volume,
  {_full("lv", 20, f"(lv - avg(lv) {_rows(20)}) / nullif(stddev_pop(lv) {_rows(20)}, 0)")} AS volume_zscore_20,
  {", ".join(f"{_std('r1', n)} AS volatility_{n}" for n in (5, 10, 20, 60))},
  {", ".join(f"{_ma(n)} AS ma_deviation_{n}" for n in (5, 10, 20))},
  {_full("close", 20, f"(close - min(close) {_rows(20)}) / nullif(max(close) {_rows(20)} - min(close) {_rows(20)}, 0)")} AS price_position_20,
  {_full("close", 20, f"ln(close) - ln(max(close) {_rows(20)})")} AS breakout_20,
  {_RANK} AS cross_section_return_rank FROM x)
"""
_NUMBERS = [c for c in X.FEATURES if c not in X.FLAGS]
_V1_OUT = f"""SELECT timestamp, symbol, {", ".join(f"{r(f'coalesce({c}, 0)', 5)} AS {c}" for c in _NUMBERS)}, 0.0::DOUBLE AS is_suspended, 1.0::DOUBLE AS is_listed, 0.0::DOUBLE AS is_st, 1.0::DOUBLE AS is_tradable,
  CAST(({" AND ".join(f"{c} IS NOT NULL" for c in _NUMBERS)}) AS INTEGER) AS valid FROM f"""


def _v1(s, d):
    return X.bar_v1(monthly_bars(s, d))


def _labels_v2(s, d):
    cols = ["timestamp", "symbol", "return_raw", "expected_return", "realized_volatility", "downside_semivol", "direction", "label_valid"]
    return rounded_columns(L.v2(monthly_bars(s, d), cost=0.0).select(*cols), 5)


def _holding(h: int, lag: int) -> str:
    """The sub-returns of the holding path as columns of one sum."""
    first = f"lead(ln(close / open), {lag}) {_W}"
    rest = [f"lead(step, {k}) {_W}" for k in range(lag + 1, lag + h + 1)]
    return ", ".join([first, *rest])


_V2 = f"""
{BARS}, x AS (SELECT *, ln(close / lag(close) {_W}) AS step FROM bars),
p AS (SELECT timestamp, symbol, lead(open, 1) {_W} AS eo, lead(close, 6) {_W} AS xc, list_value({_holding(5, 1)}) AS path FROM x),
q AS (SELECT *, eo IS NOT NULL AND xc IS NOT NULL AS ok, list_aggregate(path, 'sum') / 6 AS mean FROM p)
"""


def _splits(s, d, **k):
    return L.walk_forward(monthly_bars(s, d), **k).groupBy("window", "part").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


def _split_sql(train: int, val: int, test: int, step: int, gap: int, expanding: bool) -> str:
    lo = "0" if expanding else f"k * {step}"
    end = f"{train} + k * {step}"
    return f"""WITH {BARS}, t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM bars)),
b AS (SELECT CAST(k AS INTEGER) AS "window", part, lo, hi FROM range(100) g(k), LATERAL (SELECT * FROM (VALUES ('train', {lo}, {end}), ('validation', {end} + {gap}, {end} + {gap} + {val}), ('test', {end} + {gap} + {val} + {gap}, {end} + {gap} + {val} + {gap} + {test})) v(part, lo, hi))
 WHERE {end} + {gap} + {val} + {gap} + {test} <= (SELECT max(n) FROM t))
SELECT "window", part, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM b JOIN t ON i >= b.lo AND i < b.hi GROUP BY 1, 2"""


def _flagship(s, d):
    """Features, the five best valid momentum scores of each month, their next-open returns, growth and drawdown."""
    b = monthly_bars(s, d)
    f = X.bar_v1(b).filter("valid = 1").select("timestamp", "symbol", rounded(F.col("log_return_20")).alias("score"))
    best = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("score"), "symbol"))
    picks = f.withColumn("rank", best).filter("rank <= 5")
    returns = L.next_open(b).filter("label_valid").select("timestamp", "symbol", "expected_return")
    months = picks.join(returns, ["timestamp", "symbol"]).groupBy("timestamp").agg(F.avg("expected_return").alias("mean"), F.count("*").alias("n"))
    run = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    out = months.withColumn("growth", F.exp(F.sum("mean").over(run)))
    out = out.withColumn("drawdown", F.col("growth") / F.greatest(F.max("growth").over(run), F.lit(1.0)) - 1)
    return rounded_columns(out, 5)


QUERIES = {
    "flagship_topk_growth": (
        _flagship,
        f"""WITH {_V1}, v AS (SELECT timestamp, symbol, {r("log_return_20")} AS score FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _NUMBERS)}),
p AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol) AS k FROM v),
l AS (SELECT timestamp, symbol, ln(lead(close, 2) {_W} / lead(open, 1) {_W}) AS er FROM bars),
m AS (SELECT timestamp, avg(er) AS mean, count(*) AS n FROM p JOIN l USING (timestamp, symbol) WHERE k <= 5 AND er IS NOT NULL GROUP BY 1),
g AS (SELECT *, exp(sum(mean) OVER (ORDER BY timestamp)) AS growth FROM m)
SELECT timestamp, {r("mean", 5)} AS mean, n, {r("growth", 5)} AS growth, {r("growth / greatest(max(growth) OVER (ORDER BY timestamp), 1.0) - 1", 5)} AS drawdown FROM g""",
    ),
    "feat_bar_v1": (lambda s, d: rounded_columns(_v1(s, d).withColumn("valid", F.col("valid").cast("int")), 5), f"WITH {_V1} {_V1_OUT}"),
    "feat_standardize": (
        lambda s, d: rounded_columns(X.standardize(_v1(s, d).filter("valid = 1").select("timestamp", "symbol", "log_return_1", "volatility_20"), ["log_return_1", "volatility_20"], F.col("timestamp") < FROM), 4),
        f"WITH {_V1}, v AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NUMBERS)}), t AS (SELECT avg(log_return_1) AS a1, stddev_pop(log_return_1) AS s1, avg(volatility_20) AS a2, stddev_pop(volatility_20) AS s2 FROM v WHERE timestamp < {FROM}) SELECT timestamp, symbol, {r('(log_return_1 - a1) / CASE WHEN s1 < 1e-6 THEN 1 ELSE s1 END', 4)} AS log_return_1, {r('(volatility_20 - a2) / CASE WHEN s2 < 1e-6 THEN 1 ELSE s2 END', 4)} AS volatility_20 FROM v, t",
    ),
    "feat_normalize_clip": (
        lambda s, d: rounded_columns(X.clipped(scored(s, d).select("timestamp", "symbol", "score"), ["score"], F.col("timestamp") < FROM, 2.0), 4),
        f"WITH {SCORED}, t AS (SELECT avg(score) AS a, stddev_pop(score) AS s FROM scored WHERE timestamp < {FROM}) SELECT timestamp, symbol, {r('greatest(least((score - a) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 2.0), -2.0)', 4)} AS score FROM scored, t",
    ),
    "feat_last_valid": (
        lambda s, d: rounded_columns(X.last_valid(_v1(s, d), ["log_return_1"]), 5),
        f"WITH {_V1}, v AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NUMBERS)}) SELECT symbol, max(timestamp) AS timestamp, {r('arg_max(log_return_1, timestamp)', 5)} AS log_return_1 FROM v GROUP BY 1",
    ),
    "win_left_padded_windows": (
        lambda s, d: X.padded_windows(scored(s, d), ["score", "label"], 4).select("timestamp", "symbol", F.size("window").cast("int").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("filled")),
        f"WITH {SCORED} SELECT timestamp, symbol, 4::INTEGER AS n, CAST(least(4, row_number() OVER (PARTITION BY symbol ORDER BY timestamp)) AS INTEGER) AS filled FROM scored",
    ),
    "win_stream_history_reset": (
        lambda s, d: X.bar_v1(monthly_bars(s, d).filter("volume % 6 <> 0").withColumn("seq", F.months_between(F.timestamp_seconds(F.col("timestamp") / 1000000000), F.lit("1990-01-01")).cast("long")), "seq").groupBy("symbol").agg(F.sum(F.col("valid").cast("long")).alias("n_valid"), F.count_if(F.col("log_return_1") != 0).alias("n_returns")),
        None,
    ),
    "win_diff_k": one("d5", lambda: F.ln("close") - F.lag(F.ln("close"), 5).over(by_symbol()), f"ln(close) - lag(ln(close), 5) {_W}"),
    "win_overnight_gap": one("gap", lambda: F.ln("open") - F.lag(F.ln("close")).over(by_symbol()), f"ln(open) - lag(ln(close)) {_W}"),
    "win_rolling_std_pop": one("std20", lambda: X.rolling_std(F.col("r1"), 20), _std("r1", 20)),
    "win_rolling_zscore": one("z", lambda: X.zscore(F.col("close"), 20), _full("close", 20, f"(close - avg(close) {_rows(20)}) / nullif(stddev_pop(close) {_rows(20)}, 0)")),
    "win_ma_deviation": one("ma10", lambda: X.ma_deviation(F.col("close"), 10), _ma(10)),
    "win_price_position": one("pos", lambda: X.price_position(F.col("close"), 20), _full("close", 20, f"(close - min(close) {_rows(20)}) / nullif(max(close) {_rows(20)} - min(close) {_rows(20)}, 0)")),
    "win_breakout": one("b", lambda: X.breakout(F.col("close"), 20), _full("close", 20, f"ln(close) - ln(max(close) {_rows(20)})")),
    "win_cs_pct_rank": one("rank", lambda: percent_rank_average(F.col("r1"), "timestamp"), _RANK),
    "win_rank_relevance": (
        lambda s, d: scored(s, d).withColumn("n", F.count("*").over(Window.partitionBy("timestamp"))).select("timestamp", "symbol", rounded(F.when(F.col("n") == 1, 0.5).otherwise((average_rank(F.col("label"), "timestamp") - 1) / F.nullif(F.col("n") - 1, F.lit(0)))).alias("relevance")),
        f"WITH {SCORED} SELECT timestamp, symbol, {r('CASE WHEN count(*) OVER t = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY timestamp ORDER BY label) + (count(*) OVER (PARTITION BY timestamp, label) - 1) / 2.0 - 1) / nullif(count(*) OVER t - 1, 0) END')} AS relevance FROM scored WINDOW t AS (PARTITION BY timestamp)",
    ),
    "win_winsorize": (
        lambda s, d: scored(s, d).join(scored(s, d).groupBy("timestamp").agg(F.percentile("label", 0.05).alias("lo"), F.percentile("label", 0.95).alias("hi")), "timestamp").select("timestamp", "symbol", rounded(F.greatest(F.least("label", "hi"), F.col("lo"))).alias("x")),
        f"WITH {SCORED}, q AS (SELECT timestamp, quantile_cont(label, 0.05) AS lo, quantile_cont(label, 0.95) AS hi FROM scored GROUP BY 1) SELECT timestamp, symbol, {r('greatest(least(label, hi), lo)')} AS x FROM scored JOIN q USING (timestamp)",
    ),
    "win_lead_labels": one("fwd", lambda: F.lead("close", 6).over(by_symbol()) / F.lead("open", 1).over(by_symbol()), f"lead(close, 6) {_W} / lead(open, 1) {_W}"),
    "label_next_open": (
        lambda s, d: rounded_columns(L.next_open(monthly_bars(s, d), 3), 5),
        f"WITH {BARS}, x AS (SELECT timestamp, symbol, lead(open, 1) {_W} AS eo, lead(close, 4) {_W} AS xc FROM bars) SELECT timestamp, symbol, {r('eo', 5)} AS entry_open, {r('xc', 5)} AS exit_close, {r('ln(xc / eo)', 5)} AS expected_return, CASE WHEN ln(xc / eo) > 0 THEN 1.0 WHEN ln(xc / eo) <= 0 THEN 0.0 END::DOUBLE AS direction, {r('abs(ln(xc / eo))', 5)} AS volatility, xc IS NOT NULL AND eo IS NOT NULL AS label_valid FROM x",
    ),
    "label_next_close": (
        lambda s, d: rounded_columns(L.next_close(monthly_bars(s, d))),
        f"WITH {BARS} SELECT * FROM (SELECT timestamp, symbol, {r(f'lead(close) {_W} / close - 1')} AS label, lead(timestamp) {_W} AS known_at FROM bars) WHERE label IS NOT NULL",
    ),
    "label_v2": (
        _labels_v2,
        f"WITH {_V2} SELECT timestamp, symbol, {r('ln(xc / eo)', 5)} AS return_raw, {r('ln(xc / eo)', 5)} AS expected_return, {r('CASE WHEN ok THEN sqrt(list_aggregate(list_transform(path, lambda v: (v - mean) * (v - mean)), $$sum$$) / 6) END', 5)} AS realized_volatility, {r('CASE WHEN ok THEN sqrt(list_aggregate(list_transform(path, lambda v: CASE WHEN v < 0 THEN v * v ELSE 0 END), $$sum$$) / 6) END', 5)} AS downside_semivol, CASE WHEN ln(xc / eo) > 0 THEN 1.0 WHEN ok THEN 0.0 END::DOUBLE AS direction, ok AS label_valid FROM q",
    ),
    "win_holding_path": (
        lambda s, d: L.v2(monthly_bars(s, d)).filter("label_valid").groupBy("symbol").agg(F.count("*").alias("n"), rounded(F.avg("realized_volatility"), 5).alias("vol")),
        f"WITH {_V2} SELECT symbol, count(*) AS n, {r('avg(sqrt(list_aggregate(list_transform(path, lambda v: (v - mean) * (v - mean)), $$sum$$) / 6))', 5)} AS vol FROM q WHERE ok GROUP BY 1",
    ),
    "label_ranking_score": (
        lambda s, d: scored(s, d).select("timestamp", "symbol", rounded(L.ranking_score(F.col("label"), F.abs("score"), 0.01)).alias("x")),
        f"WITH {SCORED} SELECT timestamp, symbol, {r('label / greatest(abs(score), 0.01)')} AS x FROM scored",
    ),
    "split_chrono": (
        lambda s, d: L.chronological(monthly_bars(s, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")),
        f"WITH {BARS}, t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM bars)), p AS (SELECT timestamp, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i >= floor(n * 0.6) + 1 AND i < floor(n * 0.8) THEN 'validation' WHEN i >= floor(n * 0.8) + 1 THEN 'test' END AS part FROM t) SELECT part, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM p WHERE part IS NOT NULL GROUP BY 1",
    ),
    "split_walk_forward": (lambda s, d: _splits(s, d), _split_sql(36, 6, 6, 6, 1, False)),
    "split_expanding": (lambda s, d: _splits(s, d, train=24, step=12, expanding=True, embargo=1), _split_sql(24, 6, 6, 12, 2, True)),
    "split_oos_fixed": (
        lambda s, d: L.fixed_oos(monthly_bars(s, d), FROM, 6).groupBy("window").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo")),
        f"WITH {BARS}, t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM bars WHERE timestamp > {FROM})) SELECT CAST(floor(i / 6) AS INTEGER) AS \"window\", count(*) AS n, min(timestamp) AS lo FROM t WHERE floor(i / 6) < floor(n / 6) GROUP BY 1",
    ),
    "set_disjoint_splits": (
        lambda s, d: _disjoint(s, d),
        "SELECT CAST(0 AS BIGINT) AS n_shared",
    ),
    "win_ma_cross": (
        lambda s, d: X.moving_average_cross(monthly_bars(s, d), 3, 10),
        f"WITH {BARS}, x AS (SELECT timestamp, symbol, {_full('close', 10, f'avg(close) {_rows(3)} > avg(close) {_rows(10)}')} AS above FROM bars), y AS (SELECT *, lag(above) {_W} AS b FROM x) SELECT timestamp, symbol, CASE WHEN above THEN 'BUY' ELSE 'SELL' END AS signal FROM y WHERE b IS NOT NULL AND above <> b",
    ),
    "win_bollinger": (
        lambda s, d: rounded_columns(X.bollinger(monthly_bars(s, d), 12, 1.5), 4),
        f"WITH {BARS}, x AS (SELECT timestamp, symbol, close, {_full('close', 12, f'avg(close) {_rows(12)} - 1.5 * stddev_pop(close) {_rows(12)}')} AS lo, {_full('close', 12, f'avg(close) {_rows(12)} + 1.5 * stddev_pop(close) {_rows(12)}')} AS hi FROM bars) SELECT timestamp, symbol, {r('close', 4)} AS close, {r('lo', 4)} AS lower, {r('hi', 4)} AS upper, CASE WHEN close < lo THEN 'BUY' ELSE 'SELL' END AS signal FROM x WHERE close < lo OR close > hi",
    ),
    "win_running_peak": one("dd", lambda: F.col("close") / F.max("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) - 1, f"close / max(close) {_W} - 1"),
    "win_period_return": one("ret", lambda: F.coalesce(F.col("close") / F.lag("close").over(by_symbol()) - 1, F.lit(0.0)), f"coalesce(close / lag(close) {_W} - 1, 0.0)"),
    "win_rolling_sharpe": one("sharpe", lambda: full(F.col("r1"), X.rows(20), 20, (F.avg("r1").over(X.rows(20)) - 0.02 / 252) / F.nullif(F.stddev_samp("r1").over(X.rows(20)), F.lit(0.0)) * F.sqrt(F.lit(252.0))), _full("r1", 20, f"(avg(r1) {_rows(20)} - 0.02 / 252) / nullif(stddev_samp(r1) {_rows(20)}, 0) * sqrt(252.0)")),
    "win_cum_growth": one("growth", lambda: F.exp(F.sum("r1").over(by_symbol())), f"exp(sum(r1) {_W})"),
    "win_drawdown_duration": (
        lambda s, d: _longest(s, d),
        f"WITH {BARS}, x AS (SELECT symbol, timestamp, close < max(close) {_W} AS down FROM bars), y AS (SELECT *, count(*) FILTER (NOT down) {_W} AS island FROM x), z AS (SELECT symbol, island, count(*) FILTER (down) AS n FROM y GROUP BY 1, 2) SELECT symbol, max(n) AS longest FROM z GROUP BY 1",
    ),
    "win_transitions": (
        lambda s, d: scored(s, d).withColumn("flag", F.col("score") < -0.2).withColumn("before", F.lag("flag").over(by_symbol())).filter("before is not null").groupBy("before", "flag").agg(F.count("*").alias("n")),
        f"WITH {SCORED}, x AS (SELECT score < -0.2 AS flag, lag(score < -0.2) {_W} AS before FROM scored) SELECT before, flag, count(*) AS n FROM x WHERE before IS NOT NULL GROUP BY 1, 2",
    ),
    "win_autocorr": (
        lambda s, d: _autocorr(s, d),
        f"WITH {SCORED}, m AS (SELECT *, score - avg(score) OVER (PARTITION BY symbol) AS c FROM scored), x AS (SELECT symbol, {', '.join(f'c * lag(c, {k}) {_W} AS p{k}' for k in range(1, 4))}, c * c AS v FROM m) SELECT symbol, {', '.join(r(f'sum(p{k}) / sum(v)') + f' AS rho{k}' for k in range(1, 4))} FROM x GROUP BY 1",
    ),
    "win_newey_west": (
        lambda s, d: _newey(s, d),
        f"WITH {SCORED}, m AS (SELECT *, score - avg(score) OVER (PARTITION BY symbol) AS c, count(*) OVER (PARTITION BY symbol) AS n FROM scored), x AS (SELECT symbol, n, c, {', '.join(f'c * lag(c, {k}) {_W} AS p{k}' for k in range(1, 4))} FROM m) SELECT symbol, {r('sqrt(greatest(sum(c * c) / (max(n) - 1) + 2 * (0.75 * sum(p1) + 0.5 * sum(p2) + 0.25 * sum(p3)) / max(n), 0) / max(n))')} AS se FROM x GROUP BY 1",
    ),
    "win_ewma": (
        lambda s, d: _ewma(s, d),
        f"WITH {SCORED}, x AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) - 1 AS age FROM scored) SELECT symbol, {r('sum(score * pow(0.94, age)) / sum(pow(0.94, age))')} AS ewma FROM x GROUP BY 1",
    ),
}


def _disjoint(s, d):
    t = L.walk_forward(monthly_bars(s, d)).groupBy("window", "timestamp").agg(F.count_distinct("part").alias("n"))
    return t.agg(F.count_if(F.col("n") > 1).alias("n_shared"))


def _longest(s, d):
    peak = F.max("close").over(by_symbol())
    x = monthly_bars(s, d).withColumn("down", F.col("close") < peak).withColumn("island", F.count_if(~F.col("down")).over(by_symbol()))
    return x.groupBy("symbol", "island").agg(F.count_if("down").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest"))


def _centred(s, d):
    by = Window.partitionBy("symbol")
    return _lagged(scored(s, d).withColumns({"c": F.col("score") - F.avg("score").over(by), "n": F.count("*").over(by)}))


def _lagged(df):
    return df.withColumns({f"p{k}": F.col("c") * F.lag("c", k).over(by_symbol()) for k in range(1, 4)})


def _autocorr(s, d):
    return _centred(s, d).groupBy("symbol").agg(*(rounded(F.sum(f"p{k}") / F.sum(F.col("c") * F.col("c"))).alias(f"rho{k}") for k in range(1, 4)))


def _newey(s, d):
    """Standard error of the mean with Bartlett weights up to lag 3."""
    n = F.max("n")
    v = F.sum(F.col("c") * F.col("c")) / (n - 1) + 2 * (0.75 * F.sum("p1") + 0.5 * F.sum("p2") + 0.25 * F.sum("p3")) / n
    return _centred(s, d).groupBy("symbol").agg(rounded(F.sqrt(F.greatest(v, F.lit(0.0)) / n)).alias("se"))


def _ewma(s, d, decay: float = 0.94):
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp"))) - 1
    x = scored(s, d).withColumn("w", F.pow(F.lit(decay), age))
    return x.groupBy("symbol").agg(rounded(ratio(F.sum(F.col("score") * F.col("w")), F.sum("w"))).alias("ewma"))
