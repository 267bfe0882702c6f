"""Models, gates, remaining tests and the scalar function families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import close_to, log_add_exp, rounded, sigmoid
from tickforge.operators import analytics as A
from tickforge.operators import backtest as B
from tickforge.operators import drift as D
from tickforge.operators import features as X
from tickforge.operators import labels as L
from tickforge.operators import metrics as M
from tickforge.operators import models as Y
from tickforge.operators import policy as P
from tickforge.operators import risk as K
from tickforge.operators import scan as S
from tickforge.plans.common import FROM, SCORED, r, rounded_columns, scored
from tickforge.plans.features import _V1
from tickforge.plans.feeds import _lake, _recordings, _reports
from tickforge.plans.portfolio import _ORDERS, _TARGETS, NATIONS, _nations, _panel, _returns, _scalars, _weights
from tickforge.plans.portfolio import _orders as _all_orders
from tickforge.sources import files
from tickforge.sources.tables import BARS, FILLS, fills, monthly_bars, table
from tickforge.streaming import features as SF
from tickforge.streaming import feed, log

_NUMBERS = ["log_return_1", "volatility_20", "ma_deviation_10", "price_position_20"]


def _dataset(s, d):
    """Valid features with the next return."""
    f = X.bar_v1(monthly_bars(s, d)).filter("valid = 1").select("timestamp", "symbol", *_NUMBERS)
    return f.join(L.next_close(monthly_bars(s, d)).select("timestamp", "symbol", "label"), ["timestamp", "symbol"]).persist()


def _windows(s, data):
    return L.walk_forward(data, 12, 3, 3, 3, 1)


def _evaluated(s, d, x=_NUMBERS):
    data = _dataset(s, d)
    rows = Y.walk_forward(data, _windows(s, data), x, "label")
    return s.createDataFrame([(k["window"], k["alpha"], k["mae"], k["ic"], k["coverage"], k["n"]) for k in rows], "window int, alpha double, mae double, ic double, coverage double, n long")


def _ablation(s, d):
    out = None
    for gone in [None, *_NUMBERS]:
        part = _evaluated(s, d, [c for c in _NUMBERS if c != gone]).agg(F.avg("mae").alias("mae"), F.avg("ic").alias("ic")).withColumn("without", F.lit(gone or "nothing"))
        out = part if out is None else out.unionByName(part)
    return out


def _ridge(s, d):
    w = Y.ridge(scored(s, d), ["score"], "label")
    return s.createDataFrame([(k, float(v)) for k, v in zip(("intercept", "score"), w, strict=True)], "name string, value double").select("name", rounded(F.col("value")).alias("value"))


def _logistic(s, d):
    w = Y.logistic(scored(s, d).withColumn("y", (F.col("label") > 0).cast("double")), ["score"], "y")
    return s.createDataFrame([(k, float(v)) for k, v in zip(("intercept", "score"), w, strict=True)], "name string, value double")


def _rules(s, d):
    """Score of each rule and its rank IC."""
    base = scored(s, d).withColumns({"momentum": F.col("score"), "reversal": -F.col("score"), "equal_weight": F.lit(0.0), "cash": F.lit(0.0)})
    long = base.unpivot(["timestamp", "symbol", "label"], ["momentum", "reversal", "equal_weight", "cash"], "model", "s")
    return long.groupBy("model", "timestamp").agg(M.pearson(F.col("s"), F.col("label")).alias("ic")).groupBy("model").agg(rounded(F.avg("ic")).alias("ic"))


_RULES = SCORED + ", m AS (SELECT timestamp, label, unnest(['momentum', 'reversal', 'equal_weight', 'cash']) AS model, unnest([score, -score, 0.0, 0.0]) AS s FROM scored), i AS (SELECT model, timestamp, CASE WHEN stddev_pop(s) * stddev_pop(label) <= 1e-15 THEN 0.0 ELSE covar_pop(s, label) / (stddev_pop(s) * stddev_pop(label)) END AS ic FROM m GROUP BY 1, 2)"


def _predictions(s, d):
    return scored(s, d).select("timestamp", (F.col("timestamp") + F.when(F.col("relevance") == 0, -1).otherwise(5)).alias("batch_timestamp"), F.when(F.col("relevance") == 1, 2).otherwise(1).alias("version"), "symbol", F.col("score").alias("expected_return"), F.when(F.col("label") > 1, 1.5).otherwise(0.5).alias("confidence"), F.when(F.col("relevance") == 3, 3).otherwise(1).alias("flags"))


def _gate(s, d):
    orders = monthly_bars(s, d).select("timestamp", "symbol", (F.col("volume") % 12 * 50).alias("quantity"))
    bars = monthly_bars(s, d).filter("volume % 10 <> 0").select("timestamp", "symbol", (F.col("volume") % 7 != 0).alias("is_trusted"), (F.col("volume") % 5 == 0).alias("is_suspended"))
    return P.risk_gate(orders, bars, 400).groupBy("decision").agg(F.count("*").alias("n"))


def _orders(s, d):
    f = fills(s, d).select("side", (F.col("quantity") * 10 - 20).alias("quantity"), F.when(F.col("l_partkey") % 9 == 0, "STOP").when(F.col("l_partkey") % 2 == 0, "LIMIT").otherwise("MARKET").alias("type"), F.when(F.col("l_partkey") % 4 == 0, F.col("price")).alias("limit"), (F.col("l_partkey") % 11 != 0).alias("listed"), F.lit(30).alias("held"))
    return f.select(P.order_status(100).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _policy(s, d):
    last = monthly_bars(s, d).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("close"), F.max_by("volume", "timestamp").alias("v"))
    weights = last.filter("v % 3 = 0").select("symbol", (0.001 * (F.col("v") % 5)).alias("weight"))
    positions = last.filter("v % 2 = 0").select("symbol", (F.col("v") % 4 * 100).alias("quantity"), (F.col("v") % 3 * 100).alias("sellable"))
    return P.weights_to_orders(weights, last.select("symbol", "close"), positions, 1e9)


_POLICY = BARS + ", l AS (SELECT symbol, arg_max(close, timestamp) AS close, arg_max(volume, timestamp) AS v FROM bars GROUP BY 1), x AS (SELECT symbol, close, CASE WHEN v % 3 = 0 THEN 0.001 * (v % 5) ELSE 0 END AS w, CASE WHEN v % 2 = 0 THEN v % 4 * 100 ELSE 0 END AS q, CASE WHEN v % 2 = 0 THEN v % 3 * 100 ELSE 0 END AS se FROM l WHERE v % 3 = 0 OR v % 2 = 0), t AS (SELECT symbol, CAST(floor(1e9 * CAST(w AS DOUBLE) / close / 100) * 100 AS BIGINT) - q AS dl, se FROM x), u AS (SELECT symbol, CASE WHEN dl < 0 THEN -least(-dl, se) ELSE dl END AS dl FROM t) SELECT symbol, CASE WHEN dl > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(dl) AS quantity, 'OK' AS status FROM u WHERE dl <> 0"


def _trials(s, d):
    x = _nations(s, d)
    a, b = (x.select("timestamp", F.col("symbol").alias(k), F.col("r").alias(f"r{k}")) for k in "ab")
    pairs = a.join(b, "timestamp").filter("a < b").groupBy("a", "b").agg(F.abs(F.corr("ra", "rb")).alias("c"))
    n = F.lit(x.select("symbol").distinct().count())
    return pairs.agg(F.avg("c").alias("c")).select(rounded(n / (1 + (n - 1) * F.col("c"))).alias("trials"))


def _deflated(s, d):
    x = _returns(s, d)
    m = x.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    z = (F.col("r") - F.col("m")) / F.col("sd")
    rows = x.join(m, "symbol").groupBy("symbol", "n", "m", "sd").agg((F.sum(F.pow(z, 3)) / F.col("n")).alias("m3"), (F.sum(F.pow(z, 4)) / F.col("n")).alias("m4"))
    rows = rows.crossJoin(F.broadcast(m.agg(F.count("*").alias("trials"))))

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = [(k.symbol, *(float(v) for v in D.deflated_sharpe(k.n, k.m, k.sd, k.m3, k.m4, k.trials))) for k in frame.itertuples()]
            yield pd.DataFrame(found, columns=["symbol", "z", "p"])

    return rows.mapInPandas(run, "symbol string, z double, p double")


def _embedding(s, d):
    """Effective rank, and the discrepancy of the halves, of all vectors of a panel."""
    e = table(s, d, "embeddings").select(F.expr("vec_id % 2").cast("int").alias("panel"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = e.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    def run(pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values("id")["v"].to_list()) if len(pdf) > 2 else None
        rows = [] if x is None else [("rank", K.effective_rank(K.sample_cov(x))), ("mmd", K.mmd_whole(x[: len(x) // 2], x[len(x) // 2 :]))]
        return pd.DataFrame([(pdf["panel"].iloc[0], k, float(v)) for k, v in rows], columns=["panel", "name", "value"])

    return whole.groupBy("panel").applyInPandas(run, "panel int, name string, value double").select("panel", "name", rounded(F.col("value")).alias("value"))


def _shared(s, d, cash=1e6):
    """All symbols in one portfolio, each with an equal share of the cash as its budget."""
    bars = monthly_bars(s, d)
    n = max(1, bars.select("symbol").distinct().count())
    out = B.run_groups(bars.withColumn("run", F.lit("shared")), lambda _: B.cross_strategy(3, 8, budget=cash / n), B.Rules(cash=cash))
    return out.filter("kind = 'equity'").agg(F.count("*").alias("n"), rounded(F.max_by("value", "timestamp"), 2).alias("equity"))


def _period(s, d):
    """Fills assigned to half-open periods of 90 days."""
    f = fills(s, d).withColumn("period", F.expr("timestamp div 7776000000000000"))
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    return f.groupBy("symbol", "period").agg(F.sum(signed).alias("traded"), rounded(F.sum("fee"), 2).alias("fees"))


def _factor_fit(s, d):
    dims = table(s, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("s_acctbal") / 10000).alias("x"))
    data = scored(s, d).join(dims, "symbol")

    def fit(pdf):
        import pandas as pd

        design = np.column_stack((np.ones(len(pdf)), pdf["x"]))
        w = K.wls(design, pdf["label"].to_numpy(), np.ones(len(pdf)))
        return pd.DataFrame([(pdf["timestamp"].iloc[0], float(w[0]), float(w[1]))], columns=["timestamp", "market", "size"])

    out = data.select("timestamp", "x", "label").groupBy("timestamp").applyInPandas(fit, "timestamp long, market double, size double")
    return rounded_columns(out)


def _lineage(s, d):
    lake = _lake(s, d)
    first, again, other = lake.lineage(symbols=["a"]), lake.lineage(symbols=["a"]), lake.lineage(symbols=["b"])
    return s.createDataFrame([(first == again, first != other)], "stable boolean, distinct boolean")


def _report(s, d):
    m = A.return_metrics(_returns(s, d), "symbol", periods=12.0).select("symbol", "n", "cumulative_return")
    return m.select("symbol", F.to_json(F.struct("symbol", "n", rounded(F.col("cumulative_return"), 4).alias("c"))).alias("report")).withColumn("digest", F.sha2("report", 256)).select("symbol", "digest")


def _whole_run(s, d, rules=B.Rules(cash=1e7)):
    """All bars of all symbols, one portfolio: moving averages cross, market orders at the next open."""
    bars = monthly_bars(s, d).withColumn("run", F.lit("5-20"))
    out = B.run_groups(bars, lambda name: B.cross_strategy(*map(int, name.split("-")), 10), rules)
    return out.groupBy("kind").agg(F.count("*").alias("n"), rounded(F.max_by("value", "timestamp"), 2).alias("last"))


def _by_symbol_run(s, d, wishes, rules):
    """Each symbol's bars through an engine of its own: closed orders and fills."""
    return B.run_groups(monthly_bars(s, d).withColumn("run", F.col("symbol")), lambda _: wishes, rules)


def _limit_wish(ts, bars, held, cash):
    """A resting buy 2 % below each close."""
    return [{"symbol": x, "side": "BUY", "quantity": 1, "limit": bar["close"] * 0.98} for x, bar in sorted(bars.items())]


_AMPLE = {"cash": 1e12, "participation": 1e6}


def _limit_bars(s, d):
    """Limit fills of all symbols and bars: the order of the n-th bar fills at the first later bar that reaches it."""
    return _by_symbol_run(s, d, _limit_wish, B.Rules(**_AMPLE)).filter("kind = 'fill'").select("timestamp", "symbol", "order_id", "quantity", rounded(F.col("price")).alias("price"))


_NUMBERED = BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS k FROM bars)"

_LIMITS = (
    _NUMBERED
    + ", f AS (SELECT o.symbol, o.k AS order_id, o.close * 0.98 AS lim, min(b.k) AS at FROM n o JOIN n b ON b.symbol = o.symbol AND b.k > o.k AND b.low <= o.close * 0.98 GROUP BY ALL)"
    f" SELECT n.timestamp, f.symbol, f.order_id, CAST(1 AS BIGINT) AS quantity, {r('least(n.open, f.lim)')} AS price FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.at"
)


def _cash_wish(ts, bars, held, cash):
    """Each bar a buy far below the market that takes 30 % of the cash: the fourth finds it reserved."""
    return [{"symbol": x, "side": "BUY", "quantity": int(0.3 * cash / (bar["close"] * 1e-6)) + 1, "limit": bar["close"] * 1e-6} for x, bar in sorted(bars.items())]


def _share_wish():
    """Ten shares at the first bar, then each bar a sell of six far above the market: the second finds four free."""
    seen = set()

    def act(ts, bars, held, cash):
        out = []
        for x, bar in sorted(bars.items()):
            out.append({"symbol": x, "side": "SELL", "quantity": 6, "limit": bar["close"] * 1e6} if x in seen else {"symbol": x, "side": "BUY", "quantity": 10})
            seen.add(x)
        return out

    return act


def _statuses(out):
    return out.filter("kind = 'order'").groupBy("symbol", "side", "status").agg(F.count("*").alias("n"))


def _cash_bars(s, d):
    return _statuses(_by_symbol_run(s, d, _cash_wish, B.Rules(cash=1e7)))


def _share_bars(s, d):
    bars = monthly_bars(s, d).withColumn("run", F.col("symbol"))
    return _statuses(B.run_groups(bars, lambda _: _share_wish(), B.Rules(**_AMPLE)))


_COUNTED = BARS + ", c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)"


def _timed(s, d):
    """A market order a bar: filled at the next open, or, in the other mode, at the close that brought it."""
    out = None
    for timing in ("OPEN", "CLOSE"):
        rows = _by_symbol_run(s, d, lambda ts, bars, held, cash: [{"symbol": x, "side": "BUY", "quantity": 1} for x in sorted(bars)], B.Rules(**_AMPLE, slippage_bps=0, fill_timing=timing))
        part = rows.filter("kind = 'fill'").select(F.lit(timing).alias("timing"), "timestamp", "symbol", "order_id", "price")
        out = part if out is None else out.unionByName(part)
    return out


def _action_wish(ts, bars, held, cash):
    return [{"symbol": x, "side": "BUY", "quantity": 10} for x in sorted(bars)]


def _action_bars(s, d):
    """A purchase at every bar; each bar whose volume 50 divides begins with a two for one split and a dividend of 0.1."""
    split = F.col("volume") % 50 == 0
    bars = monthly_bars(s, d).withColumns({"run": F.col("symbol"), "share_multiplier": F.when(split, 2.0), "cash_dividend_per_share": F.when(split, 0.1)})
    out = B.run_groups(bars, lambda _: _action_wish, B.Rules(**_AMPLE, slippage_bps=0, fee_rate=0))
    last = F.max_by("value", F.when(F.col("kind") == "equity", F.col("timestamp")))
    return out.groupBy(F.col("run").alias("symbol")).agg(F.count_if(F.col("status") == "CANCELED").alias("canceled"), F.count_if(F.col("kind") == "fill").alias("fills"), rounded(last - 1e12, 1).alias("gain"))


_ACTIONS = (
    _NUMBERED
    + ", c AS (SELECT *, volume % 50 = 0 AS split, sum(CASE WHEN volume % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY k) AS splits, max(k) OVER (PARTITION BY symbol) AS m FROM n),"
    " f AS (SELECT * FROM c WHERE k > 1 AND NOT split),"
    " dv AS (SELECT c.symbol, sum(0.1 * 10 * pow(2, c.splits - 1 - f.splits)) AS paid FROM c JOIN f ON f.symbol = c.symbol AND f.k < c.k WHERE c.split GROUP BY 1),"
    " e AS (SELECT f.symbol, sum(10 * pow(2, l.splits - f.splits) * l.close - 10 * f.open) AS made FROM f JOIN c l ON l.symbol = f.symbol AND l.k = l.m GROUP BY 1)"
    f" SELECT c.symbol, count(*) FILTER (split AND k > 1) AS canceled, count(*) FILTER (NOT split AND k > 1) AS fills, {r('coalesce(any_value(made), 0) + coalesce(any_value(paid), 0)', 1)} AS gain"
    " FROM c LEFT JOIN e USING (symbol) LEFT JOIN dv USING (symbol) GROUP BY 1"
)


def _decisions(s, d):
    """All target orders as a log a symbol, written and read again."""
    order = Window.partitionBy("symbol").orderBy("timestamp")
    rows = _all_orders(s, d).select("symbol", F.row_number().over(order).cast("long").alias("n"), F.to_json(F.struct(F.lit("target").alias("kind"), "timestamp", "symbol", "side", "quantity")).alias("payload"))
    found = log.read(log.write(rows, "symbol"), "symbol")
    return found.select(F.from_json("payload", "kind string, timestamp long, symbol string, side string, quantity long").alias("x")).select("x.*").drop("kind")


def _replay_log(s, d):
    """All events as a log a type, written and read again."""
    order = Window.partitionBy("event_type").orderBy("event_id")
    rows = table(s, d, "events").select("event_type", F.row_number().over(order).cast("long").alias("n"), F.to_json(F.struct("event_id", "event_type", "value")).alias("payload"))
    found = log.read(log.write(rows, "event_type"), "event_type")
    return found.select(F.from_json("payload", "event_id long, event_type string, value double").alias("x")).select("x.*")


def _captured(s, d):
    """Every recording decoded in pieces of 17 bytes and at once."""

    def compare(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for symbol, content in zip(frame["symbol"], frame["content"], strict=True):
                data, rest, found = bytes(content), b"", []
                for at in range(0, len(data), 17):
                    part, rest = feed.decode(rest + data[at : at + 17])
                    found += part
                out.append((symbol, len(found), found == feed.decode(data)[0] and not rest))
            yield pd.DataFrame(out, columns=["symbol", "n", "same"])

    return _recordings(s, d).select("symbol", "content").mapInPandas(compare, "symbol string, n long, same boolean").groupBy("symbol").agg(F.sum("n").alias("n"), F.min("same").alias("same"))


def _model_strategy(s, d):
    """Scores to targets to orders for what changes, to fills, each a DataFrame stage; the risk gate stands before execution."""
    px = scored(s, d, "close").select("timestamp", "symbol", "score", "close")
    targets = B.top_k_targets(px, 5, 1_000_000.0, 0.1, 10)
    orders = B.targets_to_orders(targets, B.held_before(targets))
    bars = monthly_bars(s, d).select("timestamp", "symbol", F.lit(True).alias("is_trusted"), (F.col("volume") % 50 == 0).alias("is_suspended"))
    passed = P.risk_gate(orders, bars, 1_000_000, 10).filter("decision = 'ACCEPT'").drop("decision")
    return B.next_open_fills(passed, monthly_bars(s, d)).groupBy("side").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


_MODEL = (
    _TARGETS
    + ", ps AS (SELECT timestamp, symbol, target, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY timestamp), 0) AS held FROM tg),"
    " od AS (SELECT timestamp, symbol, target - held AS delta FROM ps JOIN bars USING (timestamp, symbol) WHERE target <> held AND volume % 50 <> 0 AND abs(target - held) <= 1000000 AND abs(target - held) % 10 = 0),"
    " nb AS (SELECT symbol, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS timestamp, volume FROM bars),"
    " x AS (SELECT CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, least(abs(delta), CAST(floor(volume * 0.25) AS BIGINT)) AS quantity FROM od JOIN nb USING (timestamp, symbol))"
    " SELECT side, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM x WHERE quantity > 0 GROUP BY 1"
)


def _portfolio_grid(s, d):
    """Rule x slippage, replayed as independent runs, and the metrics of each."""
    out = None
    for bps in (0.0, 5.0, 10.0):
        bars = monthly_bars(s, d).withColumn("run", F.explode(F.array(F.lit("3-10"), F.lit("5-20"))))
        rows = B.run_groups(bars, lambda name: B.cross_strategy(*map(int, name.split("-")), 10), B.Rules(slippage_bps=bps)).filter("kind = 'equity'").select("run", "timestamp", F.col("value").alias("equity"))
        part = B.equity_metrics(rows, 1_000_000.0, "run").withColumn("slippage", F.lit(bps))
        out = part if out is None else out.unionByName(part)
    return rounded_columns(out.select("run", "slippage", "total_return", "max_drawdown", "n_days"))


def _replayed(s, d):
    out = SF.replay(monthly_bars(s, d))
    return out.select("timestamp", "symbol", *(rounded(F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c)), 5).alias(c) for c in SF.NUMBERS))


_REPLAYED = f"WITH {_V1} SELECT timestamp, symbol, {', '.join(f'{r(f'coalesce({c}, 0)', 5)} AS {c}' for c in SF.NUMBERS)} FROM f"

QUERIES = {
    "feat_bar_v1_stream": (_replayed, _REPLAYED),
    "st_features": (_replayed, _REPLAYED),
    "bt_runner": (_whole_run, None),
    "bt_limit_order": (_limit_bars, f"WITH {_LIMITS}"),
    "bt_corporate_action": (_action_bars, f"WITH {_ACTIONS}"),
    "bt_cash_reserve": (_cash_bars, f"WITH {_COUNTED} SELECT symbol, 'BUY' AS side, 'EXPIRED' AS status, least(n, 3) AS n FROM c UNION ALL SELECT symbol, 'BUY', 'REJECTED', n - 3 FROM c WHERE n > 3"),
    "bt_sell_reserve": (
        _share_bars,
        f"WITH {_COUNTED} SELECT symbol, 'BUY' AS side, CASE WHEN n > 1 THEN 'FILLED' ELSE 'EXPIRED' END AS status, CAST(1 AS BIGINT) AS n FROM c"
        " UNION ALL SELECT symbol, 'SELL', 'EXPIRED', 1 FROM c WHERE n > 1 UNION ALL SELECT symbol, 'SELL', 'REJECTED', n - 2 FROM c WHERE n > 2",
    ),
    "bt_fill_timing": (
        _timed,
        f"WITH {_NUMBERED}, p AS (SELECT *, lead(timestamp) OVER w AS next_ts, lead(open) OVER w AS next_open FROM n WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"
        " SELECT 'OPEN' AS timing, next_ts AS timestamp, symbol, k AS order_id, next_open AS price FROM p WHERE next_ts IS NOT NULL UNION ALL SELECT 'CLOSE', timestamp, symbol, k, close FROM p",
    ),
    "bt_decision_log": (_decisions, f"WITH {_ORDERS} SELECT timestamp, symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity FROM od"),
    "src_replay_log": (_replay_log, "SELECT event_id, event_type, value FROM events"),
    "st_capture_replay": (_captured, f"WITH {FILLS} SELECT symbol, count(*) AS n, true AS same FROM fills GROUP BY 1"),
    "bt_model_strategy": (_model_strategy, f"WITH {_MODEL}"),
    "eval_portfolio_benchmark": (_portfolio_grid, None),
    "feat_groups": (lambda s, d: s.createDataFrame([(k, n) for k, v in X.GROUPS.items() for n in v], "feature_group string, feature string"), None),
    "pm_research_policy": (_weights(lambda x: _sub_budget(x)), None),
    "model_ridge": (_ridge, f"WITH {SCORED}, s AS (SELECT count(*) AS n, sum(score) AS sx, sum(label) AS sy, sum(score * score) + 1.0 AS sxx, sum(score * label) AS sxy FROM scored) SELECT 'intercept' AS name, {r('(sxx * sy - sx * sxy) / (n * sxx - sx * sx)')} AS value FROM s UNION ALL SELECT 'score', {r('(n * sxy - sx * sy) / (n * sxx - sx * sx)')} FROM s"),
    "model_logistic": (_logistic, None),
    "model_rules": (_rules, f"WITH {_RULES} SELECT model, {r('avg(ic)')} AS ic FROM i GROUP BY 1"),
    "eval_walk_forward": (_evaluated, None),
    "feat_ablation": (_ablation, None),
    "eval_promotion": (
        lambda s, d: rounded_columns(Y.promotion(M.by_time(scored(s, d)).select(F.col("rank_ic").alias("candidate"), (-F.col("rank_ic")).alias("baseline")))),
        None,
    ),
    "validate_predictions": (
        lambda s, d: _predictions(s, d).select(P.prediction_status(1, 100).alias("status")).groupBy("status").agg(F.count("*").alias("n")),
        f"WITH {SCORED} SELECT CASE WHEN relevance = 0 THEN 'FUTURE_TIMESTAMP' WHEN relevance = 1 THEN 'VERSION_MISMATCH' WHEN relevance = 3 THEN 'STALE' WHEN label > 1 THEN 'BAD_CONFIDENCE' ELSE 'OK' END AS status, count(*) AS n FROM scored GROUP BY 1",
    ),
    "risk_gate": (
        _gate,
        f"WITH {BARS} SELECT CASE WHEN volume % 10 = 0 THEN 'UNKNOWN_SYMBOL' WHEN volume % 7 = 0 THEN 'UNTRUSTED_DATA' WHEN volume % 5 = 0 THEN 'NOT_TRADABLE' WHEN volume % 12 * 50 % 100 <> 0 THEN 'BAD_LOT' WHEN volume % 12 * 50 > 400 THEN 'TOO_LARGE' ELSE 'ACCEPT' END AS decision, count(*) AS n FROM bars GROUP BY 1",
    ),
    "order_validate": (
        _orders,
        f"WITH {FILLS}, o AS (SELECT side, quantity * 10 - 20 AS q, l_partkey AS k FROM fills) SELECT CASE WHEN q <= 0 THEN 'INVALID_QUANTITY' WHEN k % 9 = 0 THEN 'INVALID_TYPE' WHEN k % 2 = 0 AND k % 4 <> 0 THEN 'INVALID_LIMIT' WHEN k % 11 = 0 THEN 'NOT_LISTED' WHEN q % 100 <> 0 AND NOT (side = 'SELL' AND q = 30) THEN 'ODD_LOT' ELSE 'OK' END AS status, count(*) AS n FROM o GROUP BY 1",
    ),
    "validate_bar_v1": (
        lambda s, d: S.validate(monthly_bars(s, d)).select("n_rows", "bad_range", "negative_volume", "bad_timestamp"),
        f"WITH {BARS} SELECT count(*) AS n_rows, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS bad_range, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (timestamp <= 0) AS bad_timestamp FROM bars",
    ),
    "bt_policy_to_orders": (_policy, f"WITH {_POLICY}"),
    "stat_effective_trials": (
        _trials,
        f"WITH {NATIONS}, n AS (SELECT count(DISTINCT symbol) AS n FROM nat), c AS (SELECT abs(corr(a.r, b.r)) AS c FROM nat a JOIN nat b ON a.timestamp = b.timestamp AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol) SELECT {r('max(n) / (1 + (max(n) - 1) * avg(c))')} AS trials FROM c, n",
    ),
    "stat_deflated_sharpe": (_deflated, None),
    "stat_mbb_ci": (_scalars(lambda x: list(zip(("mean", "p", "lo", "hi"), K.stationary_bootstrap(x[:, 0], 6.0, 99, 11), strict=True))), None),
    "tr_expectile": (_scalars(lambda x: [(f"e{int(q * 100)}", K.expectile(x[:, 0], q)) for q in (0.05, 0.5, 0.95)]), None),
    "tr_evt": (_scalars(lambda x: list(zip(("var", "es"), K.evt_tail(-x[:, 0], 0.99, 0.8), strict=True))), None),
    "pm_weighted_stats": (
        lambda s, d: scored(s, d).withColumn("w", F.exp("score")).groupBy("symbol").agg(rounded(F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("mean"), rounded(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 4).alias("ess")),
        f"WITH {SCORED} SELECT symbol, {r('sum(exp(score) * label) / sum(exp(score))')} AS mean, {r('pow(sum(exp(score)), 2) / sum(exp(score) * exp(score))', 4)} AS ess FROM scored GROUP BY 1",
    ),
    "pm_matrix_checks": (_scalars(lambda x: [("symmetric", float(np.allclose(K.sample_cov(x), K.sample_cov(x).T))), ("least_eigenvalue_ok", float(np.linalg.eigvalsh(K.sample_cov(x))[0] > -1e-12))]), None),
    "pm_cov_compare": (_scalars(lambda x: [("sample_lw", float(np.linalg.norm(K.sample_cov(x) - K.ledoit_wolf(x)[0]))), ("sample_rmt", float(np.linalg.norm(K.sample_cov(x) - K.denoise(K.sample_cov(x), len(x)))))]), None),
    "pm_factor_variance": (_scalars(lambda x: [("variance", float(np.full(x.shape[1], 1 / x.shape[1]) @ K.sample_cov(x) @ np.full(x.shape[1], 1 / x.shape[1])))]), None),
    "pm_nco_ffv": (_weights(lambda x: K.nco(K.weighted_stats(x, K.entropy_tilt(np.full(len(x), 1 / len(x)), x[:, :1], x[:, :1].mean(0) + 0.001))["cov"], K.onc(K.sample_cov(x)))), None),
    "pm_factor_fit": (
        _factor_fit,
        f"WITH {SCORED}, x AS (SELECT timestamp, label AS y, s_acctbal / 10000 AS x FROM scored JOIN supplier ON CAST(symbol AS BIGINT) = s_suppkey) SELECT timestamp, {r('regr_intercept(y, x)')} AS market, {r('regr_slope(y, x)')} AS size FROM x GROUP BY 1",
    ),
    "drift_embedding": (_embedding, None),
    "drift_corr_mmd_variant": (lambda s, d: K.per_group(_panel(s, d).withColumn("panel", F.lit(0)), lambda x, names: [("frobenius", float(np.linalg.norm(np.corrcoef(x[: len(x) // 2].T) - np.corrcoef(x[len(x) // 2 :].T)))), ("mmd", K.mmd(K.evenly(x[: len(x) // 2]), K.evenly(x[len(x) // 2 :])))]), None),
    "drift_report": (lambda s, d: _drift_report(s, d), None),
    "audit_noise_flip": (
        lambda s, d: _flip(s, d),
        None,
    ),
    "audit_stress_sets": (
        lambda s, d: scored(s, d).select(*(rounded(F.avg(F.abs(F.col("score") * k - F.col("label")))).alias(n) for n, k in (("base", 1.0), ("price", 1.05), ("vol", 2.0)))),
        f"WITH {SCORED} SELECT {r('avg(abs(score * 1.0 - label))')} AS base, {r('avg(abs(score * 1.05 - label))')} AS price, {r('avg(abs(score * 2.0 - label))')} AS vol FROM scored",
    ),
    "audit_hypotheses": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("trial"), F.min("o_orderdate").alias("registered"), F.max("o_orderdate").alias("available")).agg(F.count("*").alias("n"), F.count_if(F.col("registered") >= F.col("available")).alias("late"), F.count_distinct("trial").alias("trials")),
        "WITH t AS (SELECT o_custkey, min(o_orderkey) AS trial, min(o_orderdate) AS r, max(o_orderdate) AS a FROM orders GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (r >= a) AS late, count(DISTINCT trial) AS trials FROM t",
    ),
    "sampler_cross_section": (
        lambda s, d: scored(s, d).withColumn("batch", F.pmod(F.xxhash64(F.col("timestamp"), F.lit(7)), F.lit(8))).groupBy("batch").agg(F.count_distinct("timestamp").alias("times"), F.count("*").alias("n")),
        None,
    ),
    "bt_shared_portfolio": (_shared, None),
    "bt_event_queue": (
        lambda s, d: table(s, d, "events").orderBy("ts", "event_id").select("event_id"),
        "SELECT event_id FROM events",
    ),
    "pa_period_coordinator": (
        _period,
        f"WITH {FILLS} SELECT symbol, timestamp // 7776000000000000 AS period, CAST(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS traded, {r('sum(fee)', 2)} AS fees FROM fills GROUP BY 1, 2",
    ),
    "pa_report": (_report, None),
    "st_exec_report": (
        lambda s, d: feed.order_states(_reports(s, d)).agg(F.count_if("terminal").alias("archived"), F.sum("duplicates").alias("duplicates")),
        "SELECT count(*) FILTER (o_custkey % 3 < 2) AS archived, count(*) AS duplicates FROM orders",
    ),
    "st_reconcile": (
        lambda s, d: _recon(s, d),
        "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'LOCAL_UNKNOWN' ELSE 'MATCHED' END AS status, count(*) AS n FROM orders GROUP BY 1",
    ),
    "src_discover_files": (lambda s, d: files.discover(s, d).select(F.element_at(F.split("path", "/"), -1).alias("name")).filter("name like '%.parquet'"), None),
    "src_arrow_stream": (lambda s, d: monthly_bars(s, d).select("timestamp", "symbol").repartition(2, "symbol").sortWithinPartitions("symbol", "timestamp").mapInArrow(_ordered, "timestamp long, symbol string").agg(F.count("*").alias("n")), f"WITH {BARS} SELECT count(*) AS n FROM bars"),
    "lake_iter_batches": (lambda s, d: monthly_bars(s, d).select("volume").mapInArrow(_totals, "n long, volume long").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume")), f"WITH {BARS} SELECT count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars"),
    "column_allow_list": (lambda s, d: s.createDataFrame([(c,) for c in S.allowed_columns(monthly_bars(s, d), ["close", "symbol"])], "c string"), "SELECT * FROM (VALUES ('close'), ('symbol')) t(c)"),
    "meta_preview": (lambda s, d: S.normalise(monthly_bars(s, d)).limit(20), None),
    "meta_lineage": (_lineage, "SELECT true AS stable, true AS distinct"),
    "meta_dataset_fingerprint": (lambda s, d: s.createDataFrame([(_fingerprints(s, d),)], "same boolean"), "SELECT true AS same"),
    "string": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.trim(F.concat(F.lit(" "), "p_name")).alias("t"), F.lower("p_type").alias("l"), F.col("p_brand").rlike("^[A-Za-z0-9_.#-]+$").alias("m"), F.concat_ws("\x1f", "p_brand", "p_type").alias("c"), F.endswith("p_name", F.lit("ring")).alias("e"), F.rpad("p_brand", 12, "*").alias("p")),
        "SELECT p_partkey, trim(' ' || p_name) AS t, lower(p_type) AS l, regexp_full_match(p_brand, '[A-Za-z0-9_.#-]+') AS m, p_brand || chr(31) || p_type AS c, ends_with(p_name, 'ring') AS e, rpad(p_brand, 12, '*') AS p FROM part",
    ),
    "hash": (lambda s, d: table(s, d, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("h"), F.md5("s_name").alias("m")), "SELECT s_suppkey, sha256(s_name) AS h, md5(s_name) AS m FROM supplier"),
    "math": (
        lambda s, d: scored(s, d).select("timestamp", "symbol", rounded(F.log1p(F.abs("score"))).alias("l"), rounded(sigmoid(F.col("score"))).alias("s"), rounded(log_add_exp(F.col("score"), F.col("label") / 100)).alias("a"), F.signum("score").alias("g"), F.floor(F.col("score") * 10).alias("f"), rounded(F.pow(F.lit(2.0), F.col("score"))).alias("e")),
        f"WITH {SCORED} SELECT timestamp, symbol, {r('ln(1 + abs(score))')} AS l, {r('1 / (1 + exp(-score))')} AS s, {r('ln(exp(score) + exp(label / 100))')} AS a, CAST(sign(score) AS DOUBLE) AS g, CAST(floor(score * 10) AS BIGINT) AS f, {r('pow(2.0, score)')} AS e FROM scored",
    ),
    "conditional": (
        lambda s, d: table(s, d, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("x"), F.when(F.col("l_quantity") > 40, "big").when(F.col("l_quantity") > 20, "mid").otherwise("small").alias("k")).groupBy("k").agg(F.count("x").alias("n"), F.count("*").alias("m")),
        "SELECT CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS k, count(nullif(l_discount, 0)) AS n, count(*) AS m FROM lineitem GROUP BY 1",
    ),
    "comparison": (
        lambda s, d: scored(s, d).agg(F.count_if(close_to(F.col("score"), F.col("label"), 0.1, 0.01)).alias("near"), F.count_if(F.col("score").between(-0.1, 0.1)).alias("small"), F.count_if(F.struct("symbol", "timestamp") < F.struct(F.lit("000050"), F.lit(FROM))).alias("before")),
        f"WITH {SCORED} SELECT count(*) FILTER (abs(score - label) <= 0.01 + 0.1 * abs(label)) AS near, count(*) FILTER (score BETWEEN -0.1 AND 0.1) AS small, count(*) FILTER (symbol < '000050' OR (symbol = '000050' AND timestamp < {FROM})) AS before FROM scored",
    ),
    "bitwise": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.col("o_custkey").bitwiseAND(63).alias("a"), F.shiftright("o_custkey", 2).alias("h"), (F.col("o_custkey").bitwiseAND(F.col("o_custkey") - 1) == 0).alias("p")),
        "SELECT o_orderkey, o_custkey & 63 AS a, o_custkey >> 2 AS h, (o_custkey & (o_custkey - 1)) = 0 AS p FROM orders",
    ),
    "array": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x")).select("l_orderkey", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("j"), F.aggregate("x", F.lit(0), lambda a, v: a + v).cast("long").alias("t")),
        "WITH x AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, len(x) AS n, array_to_string(x, ',') AS j, CAST(list_sum(x) AS BIGINT) AS t FROM x",
    ),
    "map": (
        lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.from_json("props", "map<string,bigint>"), "k").alias("k")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "cast": (
        lambda s, d: table(s, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("p")).groupBy("q").agg(F.count_distinct("p").alias("n")),
        "SELECT CAST(l_quantity AS BIGINT) AS q, count(DISTINCT CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS n FROM lineitem GROUP BY 1",
    ),
}


def _drift_report(s, d):
    x = scored(s, d)
    a, b = x.filter(F.col("timestamp") < FROM), x.filter(F.col("timestamp") >= FROM)
    out = None
    for column in ("score", "label"):
        for layer, rows in (("psi", D.psi_quantile(a, b, column)), ("ks", D.ks(a, b, column))):
            part = rows.select(F.lit(layer).alias("layer"), F.lit(column).alias("column"), rounded(F.col(layer)).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


def _flip(s, d, rate: float = 0.1):
    """Labels flipped by hash with probability ``rate``: Brier score before and after."""
    p = sigmoid(5 * F.col("score"))
    y = (F.col("label") > 0).cast("int")
    flip = F.pmod(F.xxhash64("timestamp", "symbol", F.lit(3)), F.lit(1000)) < int(rate * 1000)
    noisy = F.when(flip, 1 - y).otherwise(y)
    return scored(s, d).agg(rounded(F.avg(F.pow(p - y, 2))).alias("clean"), rounded(F.avg(F.pow(p - noisy, 2))).alias("noisy"), rounded(F.avg(flip.cast("double"))).alias("rate"))


def _recon(s, d):
    from tickforge.operators import temporal as T

    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 9).alias("quantity"))
    return T.reconcile(o, o.filter("order_id % 4 <> 0")).groupBy("status").agg(F.count("*").alias("n"))


def _sub_budget(x):
    """Risk-budget weights of the four best last returns, 0 elsewhere."""
    best = np.sort(np.argsort(-x[-1], kind="stable")[:4])
    out = np.zeros(x.shape[1])
    out[best] = K.risk_budget(K.sample_cov(x[:, best]))
    return out


def _ordered(batches):
    """Pass batches on; an error if keys do not rise strictly across them."""
    before = None
    for batch in batches:
        for key in zip(batch["symbol"].to_pylist(), batch["timestamp"].to_pylist(), strict=True):
            if before is not None and key <= before:
                raise ValueError(f"{key} follows {before}")
            before = key
        yield batch


def _totals(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([pc.sum(batch["volume"]).as_py() or 0], pa.int64())], ["n", "volume"])


def _fingerprints(s, d) -> bool:
    from tickforge.sources.lake import Lake

    b = monthly_bars(s, d)
    return Lake.fingerprint(b) == Lake.fingerprint(b.repartition(3)) != Lake.fingerprint(b.filter("volume > 0 and symbol <> '000001'"))


