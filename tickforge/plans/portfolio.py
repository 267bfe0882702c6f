"""Analytics, attribution, risk kernels and back-tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import rounded
from tickforge.operators import analytics as A
from tickforge.operators import backtest as B
from tickforge.operators import risk as K
from tickforge.operators.features import by_symbol
from tickforge.plans.common import FROM, SCORED, r, rounded_columns, scored
from tickforge.sources.tables import BARS, FILLS, fills, monthly_bars, table



def _returns(s, d):
    return scored(s, d).select("timestamp", "symbol", rounded(F.col("score") / 10).alias("r"))


_RET = SCORED + ", ret AS (SELECT timestamp, symbol, floor(score / 10 * 1e6 + 0.5) / 1e6 AS r FROM scored)"


def _active(s, d):
    x = _returns(s, d)
    return x.withColumn("b", rounded(F.avg("r").over(Window.partitionBy("timestamp")), 8))


_ACTIVE = _RET + f", act AS (SELECT *, {r('avg(r) OVER (PARTITION BY timestamp)', 8)} AS b FROM ret)"


def _groups(s, d):
    """Regions as groups: the portfolio holds by volume, the benchmark by count; two regions are not equity."""
    dims = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("n_regionkey").alias("g"))
    x = _returns(s, d).join(monthly_bars(s, d).select("timestamp", "symbol", "volume"), ["timestamp", "symbol"]).join(dims, "symbol")
    by = x.groupBy("timestamp", "g").agg(F.sum("volume").alias("v"), F.count("*").alias("n"), (F.sum(F.col("volume") * F.col("r")) / F.sum("volume")).alias("rp"), F.avg("r").alias("rb"))
    w = Window.partitionBy("timestamp")
    return by.select("timestamp", "g", F.when(F.col("g") == 4, "CASH").otherwise("EQUITY").alias("kind"), (F.col("v") / F.sum("v").over(w)).alias("wp"), (F.col("n") / F.sum("n").over(w)).alias("wb"), "rp", "rb")


_GROUPS = _RET + """, g0 AS (SELECT timestamp, n_regionkey AS g, sum(volume) AS v, count(*) AS n, sum(volume * r) / sum(volume) AS rp, avg(r) AS rb FROM ret JOIN bars USING (timestamp, symbol) JOIN supplier ON CAST(symbol AS BIGINT) = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
g1 AS (SELECT timestamp, g, g = 4 AS other, v * 1.0 / sum(v) OVER t AS wp, n * 1.0 / sum(n) OVER t AS wb, rp, rb FROM g0 WINDOW t AS (PARTITION BY timestamp)),
g2 AS (SELECT *, sum(wb * rb) OVER (PARTITION BY timestamp) AS bb FROM g1),
bf AS (SELECT timestamp, sum(wp * rp) AS rp, sum(wb * rb) AS rb, sum(CASE WHEN other THEN 0 ELSE (wp - wb) * (rb - bb) END) AS allocation, sum(CASE WHEN other THEN 0 ELSE wb * (rp - rb) END) AS selection, sum(CASE WHEN other THEN 0 ELSE (wp - wb) * (rp - rb) END) AS interaction, sum(CASE WHEN other THEN wp * rp - wb * rb - (wp - wb) * bb ELSE 0 END) AS other FROM g2 GROUP BY 1)"""


def _effects(s, d):
    g = A.brinson(_groups(s, d), "timestamp")
    return g.groupBy("timestamp").agg(F.sum(F.col("wp") * F.col("rp")).alias("rp"), F.sum(F.col("wb") * F.col("rb")).alias("rb"), *(F.sum(c).alias(c) for c in ("allocation", "selection", "interaction", "other")))


def _assets(s, d):
    b = monthly_bars(s, d)
    ends = b.groupBy("symbol").agg(F.min_by("open", "timestamp").alias("decision"), F.max_by("close", "timestamp").alias("end_mark"))
    return ends.select("symbol", F.lit(1000).cast("long").alias("target"), F.lit(0).cast("long").alias("begin_quantity"), "decision", "end_mark")


_ASSETS = f"{BARS}, {FILLS}, a AS (SELECT symbol, arg_min(open, timestamp) AS decision, arg_max(close, timestamp) AS e FROM bars GROUP BY 1), f AS (SELECT symbol, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS q, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END * price) AS spent, sum(fee) AS fees FROM fills GROUP BY 1)"


def _securities(s, d):
    a = _assets(s, d)
    q = fills(s, d).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("end_quantity"))
    return a.join(q, "symbol").select("symbol", F.substring("symbol", 6, 1).alias("industry"), F.lit(0).cast("long").alias("begin_quantity"), "end_quantity", F.col("decision").alias("begin_mark"), "end_mark", F.lit(10.0).alias("action_cash"))


def _ledger(s, d):
    b = monthly_bars(s, d)
    start = F.lag("close").over(by_symbol())
    x = b.withColumn("s", start).filter("s is not null").withColumn("fee", rounded(F.col("s") * 0.001))
    return x.select(
        "symbol", F.lag("timestamp", 1, 0).over(by_symbol()).alias("period_start"), F.col("timestamp").alias("period_end"), F.col("s").alias("starting_equity"),
        (F.col("close") + F.when(F.col("volume") % 9 == 0, 5.0).otherwise(0.0)).alias("ending_equity"), (F.col("close") - F.col("s") + F.col("fee")).alias("executed_gross_pnl"), F.col("fee").alias("explicit_fees"),
        (F.col("close") - F.col("s")).alias("net_pnl"), F.lit(0.0).alias("corporate_action_cash"), F.lit(0.0).alias("cash_interest"), F.lit(0.0).alias("external_cash_flow"),
    )


def _factor_rows(s, d):
    h = scored(s, d).withColumn("n", F.count("*").over(Window.partitionBy("timestamp")))
    holdings = h.select(F.col("timestamp").alias("period"), "symbol", (1 / F.col("n")).alias("weight"), F.col("label").alias("r"), F.col("timestamp").alias("decision_at"))
    ex = table(s, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.lit("SIZE").alias("factor"), (F.col("s_acctbal") / 10000).alias("x"), F.lit(0).cast("long").alias("available_at"))
    ex = ex.unionByName(ex.withColumns({"factor": F.lit("EVEN"), "x": (F.col("symbol").cast("long") % 2).cast("double")}))
    factors = scored(s, d).groupBy(F.col("timestamp").alias("period")).agg(F.avg("score").alias("f"))
    factors = factors.select("period", F.explode(F.array(F.lit("SIZE"), F.lit("EVEN"))).alias("factor"), "f")
    return A.factor_attribution(holdings, ex, factors)


def _nations(s, d):
    """Mean return of each nation's suppliers and month: a panel of 25 assets from the whole table."""
    dims = table(s, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("nation"))
    return _returns(s, d).join(dims, "symbol").groupBy("timestamp", F.col("nation").alias("symbol")).agg(F.avg("r").alias("r"))


NATIONS = _RET + ", nat AS (SELECT timestamp, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS symbol, avg(r) AS r FROM ret JOIN supplier ON CAST(symbol AS BIGINT) = s_suppkey GROUP BY 1, 2), whole AS (SELECT timestamp FROM nat GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM nat))"


def _panel(s, d):
    return _nations(s, d).withColumn("panel", (F.col("timestamp") >= FROM).cast("int"))


def _weights(kernel):
    return lambda s, d: K.per_group(_panel(s, d), lambda x, names: list(zip(names, kernel(x), strict=True))).select("panel", "name", rounded(F.col("value"), 8).alias("value"))


def _scalars(kernel):
    return lambda s, d: K.per_group(_panel(s, d), lambda x, names: kernel(x)).select("panel", "name", rounded(F.col("value"), 8).alias("value"))


def _pairs(x, names):
    c = K.sample_cov(x)
    return [(f"{a}-{b}", c[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]


def _kernel_cov(x: np.ndarray) -> np.ndarray:
    return K.sample_cov(x)


def _garch_rows(x):
    r_ = x[:, 0]
    o, a, b = K.garch(r_)
    losses = -K.filtered_scenarios(r_, o, a, b)
    var = float(np.quantile(losses, 0.95))
    v, e = K.evt_tail(losses, 0.99, 0.8)
    return [("alpha", a), ("beta", b), ("var95", var), ("evt_var", v), ("evt_es", e), ("expectile", K.expectile(r_, 0.05))]


def _losses(s, d):
    return _returns(s, d).withColumn("p", 1 / F.count("*").over(Window.partitionBy("symbol"))).select("symbol", (-F.col("r")).alias("loss"), "p")


def _var_rows(s, d):
    return _returns(s, d).withColumns({"var": F.lit(0.05), "es": F.lit(0.08)})


def _lr(n, p):
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE {n} * ln(greatest({p}, 1e-300)) END"


def _runs(s, d):
    return monthly_bars(s, d).withColumn("run", F.explode(F.array(F.lit("3-10"), F.lit("5-20"))))


def _strategy(run: str):
    short, long = map(int, run.split("-"))
    return B.cross_strategy(short, long, 10)


def _fold(s, d):
    return B.run_groups(_runs(s, d), _strategy, B.Rules())


def _prices(s, d):
    return scored(s, d, "close").select("timestamp", "symbol", "score", "close")


_TARGETS = SCORED + """, px AS (SELECT s.timestamp, s.symbol, s.score, b.close FROM scored s JOIN bars b USING (timestamp, symbol)),
ch AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol) AS k FROM px WHERE score >= 0),
nw AS (SELECT timestamp, symbol, CAST(floor(1000000 * 0.1 / close / 10) * 10 AS BIGINT) AS target FROM ch WHERE k <= 5),
tm AS (SELECT timestamp, lead(timestamp) OVER (ORDER BY timestamp) AS nx FROM (SELECT DISTINCT timestamp FROM px)),
hd AS (SELECT nx AS timestamp, symbol FROM nw JOIN tm USING (timestamp) WHERE nx IS NOT NULL),
tg AS (SELECT * FROM nw UNION ALL SELECT h.timestamp, h.symbol, 0 FROM hd h JOIN px USING (timestamp, symbol) WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.timestamp = h.timestamp AND nw.symbol = h.symbol))"""


def _targets(s, d):
    return B.top_k_targets(_prices(s, d), 5, 1_000_000.0, 0.1, 10)


def _positions(s, d):
    return monthly_bars(s, d).select("timestamp", "symbol", (F.col("volume") % 50 * 10).alias("position"))


_ORDERS = _TARGETS + ", od AS (SELECT timestamp, symbol, target - (volume % 50 * 10) AS delta FROM tg JOIN bars USING (timestamp, symbol) WHERE target <> volume % 50 * 10)"


def _orders(s, d):
    return B.targets_to_orders(_targets(s, d), _positions(s, d))


def _equity(s, d):
    x = table(s, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"), F.col("event_type").alias("run"), (1000 + F.col("value")).alias("equity"))
    return x.withColumn("run", F.col("run"))


QUERIES = {
    "pa_return_metrics": (
        lambda s, d: rounded_columns(A.return_metrics(_returns(s, d), "symbol", periods=12.0), 5),
        f"""WITH {_RET}, a AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS g, row_number() OVER (PARTITION BY symbol ORDER BY r, timestamp) AS k, count(*) OVER (PARTITION BY symbol) AS nn FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
b AS (SELECT *, g / greatest(max(g) OVER w, 1.0) - 1 AS dd FROM a WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)), c AS (SELECT *, count(*) FILTER (dd >= 0) OVER (PARTITION BY symbol ORDER BY timestamp) AS isl FROM b),
e AS (SELECT *, count(*) FILTER (dd < 0) OVER (PARTITION BY symbol, isl ORDER BY timestamp) AS under FROM c),
m AS (SELECT symbol, count(r) AS n, exp(sum(ln(1 + r))) AS g, avg(r) AS mu, stddev_samp(r) * sqrt(12.0) AS vol, sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(r)) * sqrt(12.0) AS dn, min(dd) AS dd, max(under) AS dur, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS gain, -sum(CASE WHEN r < 0 THEN r ELSE 0 END) AS loss, avg(r) FILTER (r > 0) AS mg, -avg(r) FILTER (r < 0) AS ml, avg(r) FILTER (k <= ceil(nn * 0.05)) AS cvar FROM e GROUP BY 1)
SELECT symbol, n, {r('g - 1', 5)} AS cumulative_return, {r('pow(g, 12.0 / n) - 1', 5)} AS annual_return, {r('vol', 5)} AS volatility, {r('mu * 12 / vol', 5)} AS sharpe, {r('mu * 12 / dn', 5)} AS sortino, {r('(pow(g, 12.0 / n) - 1) / -dd', 5)} AS calmar, {r('dd', 5)} AS max_drawdown, dur AS drawdown_duration, {r('win', 5)} AS win_rate, {r('gain / loss', 5)} AS profit_factor, {r('mg / ml', 5)} AS win_loss, {r('cvar', 5)} AS cvar, 'OK' AS status FROM m""",
    ),
    "pa_active_metrics": (
        lambda s, d: rounded_columns(A.active_metrics(_active(s, d), "symbol", periods=12.0), 5),
        f"""WITH {_ACTIVE}, m AS (SELECT symbol, exp(sum(ln(1 + r)) - sum(ln(1 + b))) - 1 AS ag, stddev_samp(r - b) * sqrt(12.0) AS te, avg(r - b) AS ma, covar_samp(r, b) / var_samp(b) AS beta, avg(r) AS mr, avg(b) AS mb, exp(sum(ln(1 + r)) FILTER (b > 0)) / exp(sum(ln(1 + b)) FILTER (b > 0)) AS up, exp(sum(ln(1 + r)) FILTER (b < 0)) / exp(sum(ln(1 + b)) FILTER (b < 0)) AS dn FROM act GROUP BY 1)
SELECT symbol, {r('ag', 5)} AS active_growth, {r('te', 5)} AS tracking_error, {r('ma * 12 / te', 5)} AS information_ratio, {r('beta', 5)} AS beta, {r('(mr - beta * mb) * 12', 5)} AS alpha, {r('up', 5)} AS up_capture, {r('dn', 5)} AS down_capture FROM m""",
    ),
    "pa_return_ledger": (
        lambda s, d: A.return_ledger(_ledger(s, d), "symbol").groupBy("status").agg(F.count("*").alias("n")),
        f"WITH {BARS}, x AS (SELECT symbol, timestamp, close, volume, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS s FROM bars), y AS (SELECT *, close + CASE WHEN volume % 9 = 0 THEN 5 ELSE 0 END AS e FROM x WHERE s IS NOT NULL), z AS (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY timestamp) AS pe FROM y) SELECT CASE WHEN abs(pe - s) > 1e-6 THEN 'DISCONTINUITY' WHEN abs(e - close) > 1e-6 * greatest(1, e) THEN 'IDENTITY' ELSE 'OK' END AS status, count(*) AS n FROM z GROUP BY 1",
    ),
    "pa_brinson": (
        lambda s, d: rounded_columns(_effects(s, d), 8),
        f"WITH {_GROUPS} SELECT timestamp, {', '.join(r(c, 8) + f' AS {c}' for c in ('rp', 'rb', 'allocation', 'selection', 'interaction', 'other'))} FROM bf",
    ),
    "pa_menchero": (
        lambda s, d: rounded_columns(A.menchero(_effects(s, d), ["allocation", "selection", "interaction", "other"])),
        f"WITH {_GROUPS}, t AS (SELECT count(*) AS t, exp(sum(ln(1 + rp))) - 1 AS r, exp(sum(ln(1 + rb))) - 1 AS b, sum(rp - rb) AS a, sum((rp - rb) * (rp - rb)) AS a2 FROM bf), m AS (SELECT *, (pow(1 + r, 1.0 / t) - pow(1 + b, 1.0 / t)) / (r - b) AS m FROM t), c AS (SELECT m, (r - b - m * a) / a2 AS c FROM m) SELECT {', '.join(r(f'sum((m + c * (rp - rb)) * {e})') + f' AS {n}' for e, n in (('allocation', 'allocation'), ('selection', 'selection'), ('interaction', 'interaction'), ('other', 'other'), ('(rp - rb)', 'total')))} FROM bf, c",
    ),
    "pa_shortfall": (
        lambda s, d: A.shortfall(_assets(s, d), fills(s, d)).select("symbol", *(rounded(F.col(c), 2).alias(c) for c in ("execution", "opportunity", "paper", "net", "shortfall"))),
        f"WITH {_ASSETS}, x AS (SELECT symbol, spent - decision * q AS ex, (e - decision) * (1000 - q) AS op, (e - decision) * 1000 AS pa, e * q - spent - fees AS net, fees FROM a JOIN f USING (symbol)) SELECT symbol, {r('ex', 2)} AS execution, {r('op', 2)} AS opportunity, {r('pa', 2)} AS paper, {r('net', 2)} AS net, {r('ex + fees + op', 2)} AS shortfall FROM x",
    ),
    "pa_security_contribution": (
        lambda s, d: A.contribution(_securities(s, d), fills(s, d)).groupBy("industry").agg(F.count("*").alias("n"), rounded(F.sum("market_pnl") / 1e6, 4).alias("market_pnl"), rounded(F.sum("net_pnl") / 1e6, 4).alias("net_pnl"), F.count_if(F.col("status") == "OK").alias("ok")),
        f"WITH {_ASSETS} SELECT substr(symbol, 6, 1) AS industry, count(*) AS n, {r('sum(q * e - spent) / 1e6', 4)} AS market_pnl, {r('sum(q * e - spent - fees + 10) / 1e6', 4)} AS net_pnl, count(*) AS ok FROM a JOIN f USING (symbol) GROUP BY 1",
    ),
    "pa_factor_attribution": (
        lambda s, d: _factor_rows(s, d).select("period", "factor", rounded(F.col("contribution"), 5).alias("contribution"), "status"),
        f"""WITH {SCORED}, h AS (SELECT timestamp AS period, symbol, 1.0 / count(*) OVER (PARTITION BY timestamp) AS w, label AS r FROM scored), f AS (SELECT timestamp AS period, avg(score) AS f FROM scored GROUP BY 1), e AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_acctbal / 10000 AS size, CAST(s_suppkey % 2 AS DOUBLE) AS even FROM supplier),
x AS (SELECT period, sum(w * size * f) AS s, sum(w * even * f) AS v, sum(w * r) AS t FROM h JOIN e USING (symbol) JOIN f USING (period) GROUP BY 1)
SELECT period, 'SIZE' AS factor, {r('s', 5)} AS contribution, 'OK' AS status FROM x UNION ALL SELECT period, 'EVEN', {r('v', 5)}, 'OK' FROM x UNION ALL SELECT period, 'SPECIFIC', {r('t - s - v', 5)}, 'OK' FROM x""",
    ),
    "tr_empirical": (
        lambda s, d: rounded_columns(A.empirical_tail(_losses(s, d), "symbol", level=0.9), 4),
        f"WITH {_RET}, l AS (SELECT symbol, -r AS loss, 1.0 / count(*) OVER (PARTITION BY symbol) AS p FROM ret), c AS (SELECT *, sum(p) OVER (PARTITION BY symbol ORDER BY loss RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM l), v AS (SELECT symbol, min(loss) FILTER (c + 1e-12 >= 0.9) AS v FROM c GROUP BY 1) SELECT symbol, {r('max(v)', 4)} AS var, {r('max(v) + sum(p * greatest(loss - v, 0)) / 0.1', 4)} AS es FROM l JOIN v USING (symbol) GROUP BY 1",
    ),
    "tr_backtest": (
        lambda s, d: rounded_columns(A.tail_backtest(_var_rows(s, d), "symbol").select("symbol", "n", "exceptions", "es_violations", "n01", "n11", "kupiec_lr"), 5),
        f"WITH {_RET}, h AS (SELECT symbol, timestamp, r, CAST(-r > 0.05 + 1e-12 AS INTEGER) AS h, lag(CAST(-r > 0.05 + 1e-12 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY timestamp) AS b FROM ret), c AS (SELECT symbol, count(*) AS n, CAST(sum(h) AS BIGINT) AS k, count(*) FILTER (h = 1 AND -r > 0.08) AS ev, count(*) FILTER (b = 0 AND h = 1) AS n01, count(*) FILTER (b = 1 AND h = 1) AS n11 FROM h GROUP BY 1) SELECT symbol, n, k AS exceptions, ev AS es_violations, n01, n11, {r(f'2 * greatest(0, {_lr("(n - k)", "1 - k * 1.0 / n")} + {_lr("k", "k * 1.0 / n")} - {_lr("(n - k)", "0.95")} - {_lr("k", "0.05")})', 5)} AS kupiec_lr FROM c",
    ),
    "pm_sample_cov": (
        lambda s, d: K.per_group(_nations(s, d).withColumn("panel", F.lit(0)), _pairs).select("name", rounded(F.col("value"), 8).alias("value")),
        f"WITH {NATIONS} SELECT a.symbol || '-' || b.symbol AS name, {r('covar_pop(a.r, b.r)', 8)} AS value FROM nat a JOIN nat b ON a.timestamp = b.timestamp AND a.symbol <= b.symbol WHERE a.timestamp IN (SELECT timestamp FROM whole) GROUP BY 1",
    ),
    "pm_prior": (
        lambda s, d: scored(s, d).groupBy("symbol").agg(F.count("*").alias("n"), rounded(F.avg("label")).alias("mean"), rounded(F.var_samp("label")).alias("variance"), rounded(F.min("label")).alias("lo"), rounded(F.max("label")).alias("hi")),
        f"WITH {SCORED} SELECT symbol, count(*) AS n, {r('avg(label)')} AS mean, {r('var_samp(label)')} AS variance, {r('min(label)')} AS lo, {r('max(label)')} AS hi FROM scored GROUP BY 1",
    ),
    "pm_lw_constant_corr": (_scalars(lambda x: [("delta", K.ledoit_wolf(x)[1]), ("trace", float(np.trace(K.ledoit_wolf(x)[0])))]), None),
    "pm_rmt_constant": (_scalars(lambda x: [("rank", K.effective_rank(K.denoise(_kernel_cov(x), len(x))))]), None),
    "pm_rmt_targeted": (_scalars(lambda x: [("rank", K.effective_rank(K.denoise(_kernel_cov(x), len(x), 0.5)))]), None),
    "pm_detone": (_scalars(lambda x: [("rank", K.effective_rank(K.detone(_kernel_cov(x))))]), None),
    "pm_risk_budget": (_weights(lambda x: K.risk_budget(_kernel_cov(x))), None),
    "pm_risk_contrib": (_weights(lambda x: K.risk_contributions(np.full(x.shape[1], 1 / x.shape[1]), _kernel_cov(x))), None),
    "pm_linkage": (_scalars(lambda x: [(f"merge{i}", m[2]) for i, m in enumerate(K.linkage(_kernel_cov(x))[0])]), None),
    "pm_hrp": (_weights(lambda x: K.hrp(_kernel_cov(x))), None),
    "pm_onc": (_weights(lambda x: K.onc(_kernel_cov(x)).astype(float)), None),
    "pm_nco_minvar": (_weights(lambda x: K.nco(_kernel_cov(x), K.onc(_kernel_cov(x)))), None),
    "pm_nco_rb": (_weights(lambda x: K.nco(_kernel_cov(x), K.onc(_kernel_cov(x)), K.risk_budget)), None),
    "pm_reconcile": (_weights(lambda x: K.reconcile(np.full(x.shape[1], 1 / x.shape[1]), K.hrp(_kernel_cov(x)), 1.0, 0.001, 0.1, 0.3)), None),
    "pm_bl": (_weights(lambda x: K.black_litterman(x.mean(0), _kernel_cov(x), np.eye(x.shape[1])[:1], np.array([0.01]), np.array([0.5]))[0]), None),
    "pm_ffv": (_scalars(lambda x: [("ess", K.weighted_stats(x, K.entropy_tilt(np.full(len(x), 1 / len(x)), x[:, :1], x[:, :1].mean(0) + 0.002))["ess"])]), None),
    "pm_posterior_direct": (_weights(lambda x: K.mean_variance(x.mean(0), _kernel_cov(x), 5.0, 0.4)), None),
    "tr_garch_fhs": (_scalars(_garch_rows), None),
    "stat_block_bootstrap": (_scalars(lambda x: list(zip(("mean", "p"), K.block_bootstrap(x[:, 0] - x[:, 1], 4, 199, 7), strict=True))), None),
    "stat_stationary_bootstrap": (_scalars(lambda x: list(zip(("mean", "p", "lo", "hi"), K.stationary_bootstrap(x[:, 0] - x[:, 1], 4.0, 99, 7), strict=True))), None),
    "drift_joint": (_scalars(lambda x: [("mmd", K.mmd(K.evenly(x[: len(x) // 2]), K.evenly(x[len(x) // 2 :]))), ("rank", K.effective_rank(_kernel_cov(x))), *K.joint_drift(x[: len(x) // 2], x[len(x) // 2 :])]), None),
    "drift_cka": (_scalars(lambda x: [("cka", K.linear_cka(x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]))]), None),
    "topk_long_only": (_targets, f"WITH {_TARGETS} SELECT timestamp, symbol, target FROM tg"),
    "bt_targets_to_orders": (lambda s, d: _orders(s, d), f"WITH {_ORDERS} SELECT timestamp, symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity FROM od"),
    "order_planner_sort": (lambda s, d: _orders(s, d).select("timestamp", "side", "symbol"), f"WITH {_ORDERS} SELECT timestamp, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, symbol FROM od"),
    "bt_market_order": (
        lambda s, d: rounded_columns(B.next_open_fills(_orders(s, d), monthly_bars(s, d)), 5),
        f"WITH {_ORDERS}, nb AS (SELECT symbol, timestamp AS fill_at, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS timestamp, open, volume FROM bars), x AS (SELECT fill_at, symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, least(abs(delta), CAST(floor(volume * 0.25) AS BIGINT)) AS quantity, open * CASE WHEN delta > 0 THEN 1 + 10.0 / 1e4 ELSE 1 - 10.0 / 1e4 END AS price FROM od JOIN nb USING (timestamp, symbol)) SELECT fill_at, symbol, side, quantity, {r('price', 5)} AS price FROM x WHERE quantity > 0",
    ),
    "bt_slippage": (
        lambda s, d: fills(s, d).select("order_id", "side", rounded(B.slipped(F.col("price"), F.col("side") == "BUY", 5.0), 5).alias("p")),
        f"WITH {FILLS} SELECT order_id, side, {r('price * CASE WHEN side = $$BUY$$ THEN 1 + 5.0 / 1e4 ELSE 1 - 5.0 / 1e4 END', 5)} AS p FROM fills",
    ),
    "bt_mark_to_market": (
        lambda s, d: _positions(s, d).join(monthly_bars(s, d).select("timestamp", "symbol", "close"), ["timestamp", "symbol"]).groupBy("timestamp").agg(rounded(F.sum(F.col("position") * F.col("close")) / 1e6, 4).alias("value")),
        f"WITH {BARS} SELECT timestamp, {r('sum((volume % 50 * 10) * close) / 1e6', 4)} AS value FROM bars GROUP BY 1",
    ),
    "bt_metrics": (
        lambda s, d: rounded_columns(B.equity_metrics(_equity(s, d), 1000.0, "run"), 5),
        f"""WITH q AS (SELECT event_type AS run, epoch_us(ts) * 1000 // 86400000000000 AS day, arg_max(1000 + value, ts) AS e FROM events GROUP BY 1, 2), x AS (SELECT run, day, e, e / coalesce(lag(e) OVER w, 1000.0) - 1 AS rr, 1 - e / greatest(max(e) OVER w, 1000.0) AS dd FROM q WINDOW w AS (PARTITION BY run ORDER BY day))
SELECT run, {r('arg_max(e, day) / 1000 - 1', 5)} AS total_return, {r('pow(arg_max(e, day) / 1000, 365.0 / (max(day) - min(day))) - 1', 5)} AS annual_return, {r('(avg(rr) - 0.02 / 252) / stddev_samp(rr) * sqrt(252.0)', 5)} AS sharpe, {r('max(dd)', 5)} AS max_drawdown, count(*) AS n_days FROM x GROUP BY 1""",
    ),
    "bt_book_top": (
        lambda s, d: fills(s, d).groupBy("symbol").agg(rounded(F.max(F.when(F.col("side") == "BUY", F.col("price")))).alias("bid"), rounded(F.min(F.when(F.col("side") == "SELL", F.col("price")))).alias("ask")),
        f"WITH {FILLS} SELECT symbol, {r('max(price) FILTER (side = $$BUY$$)')} AS bid, {r('min(price) FILTER (side = $$SELL$$)')} AS ask FROM fills GROUP BY 1",
    ),
    "bt_history_pages": (lambda s, d: table(s, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus").offset(200).limit(100), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200"),
    "bt_process_batch": (lambda s, d: _fold(s, d).groupBy("run", "kind").agg(F.count("*").alias("n")), None),
    "bt_position": (lambda s, d: _fold(s, d).filter("kind = 'fill'").groupBy("run", "symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("position")), None),
    "bt_round_trips": (lambda s, d: _fold(s, d).filter("kind = 'round_trip'").select("run", "timestamp", "symbol", "quantity", rounded(F.col("value"), 4).alias("net_pnl")), None),
    "bt_order_lifecycle": (lambda s, d: _fold(s, d).filter("kind = 'order'").groupBy("run", "status").agg(F.count("*").alias("n")), None),
    "bt_independent_batch": (lambda s, d: B.run_groups(monthly_bars(s, d).withColumn("run", F.col("symbol")), lambda _: B.cross_strategy(3, 10, 10), B.Rules()).filter("kind = 'equity'").groupBy("run").agg(rounded(F.max_by("value", "timestamp"), 2).alias("equity")), None),
}
