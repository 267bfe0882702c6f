"""Performance of returns and its attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import ratio


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def return_metrics(returns: DataFrame, *run: str, periods: float = 252.0, risk_free: float = 0.0, tail: float = 0.05) -> DataFrame:
    """Metrics of each run's returns ``r`` in order of ``timestamp``; results whose denominator is 0 are 0.

    A return at or below -1 makes the status INVALID, no variation ZERO_VARIANCE.
    """
    w = Window.partitionBy(*run).orderBy("timestamp")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("_l", F.when(F.col("r") > -1, F.log1p("r"))).withColumn("_w", F.exp(F.sum("_l").over(upto)))
    rows = rows.withColumn("_dd", F.col("_w") / F.greatest(F.max("_w").over(upto), F.lit(1.0)) - 1)
    rows = rows.withColumn("_island", F.count_if(F.col("_dd") >= 0).over(w)).withColumn("_rank", F.row_number().over(Window.partitionBy(*run).orderBy("r", "timestamp")))
    rows = rows.withColumn("_under", F.count_if(F.col("_dd") < 0).over(Window.partitionBy(*run, "_island").orderBy("timestamp")))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*run)))
    n, mean, sd = F.count("r"), F.avg("r"), F.stddev_samp("r")
    excess = F.col("r") - risk_free / periods
    growth = F.exp(F.sum("_l"))
    annual = F.pow(growth, periods / n) - 1
    vol = sd * F.sqrt(F.lit(periods))
    down = F.sqrt(F.sum(F.when(excess < 0, excess * excess).otherwise(0.0)) / n) * F.sqrt(F.lit(periods))
    worst = F.min("_dd")
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), -F.sum(F.when(F.col("r") < 0, F.col("r")).otherwise(0.0))
    mean_gain, mean_loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), -F.avg(F.when(F.col("r") < 0, F.col("r")))
    cut = F.ceil(F.col("_n") * tail)
    status = F.when(F.min("r") <= -1, "INVALID").when(F.coalesce(sd, F.lit(0.0)) == 0, "ZERO_VARIANCE").otherwise("OK")
    return rows.groupBy(*run).agg(
        n.alias("n"), (growth - 1).alias("cumulative_return"), annual.alias("annual_return"), _zero(vol).alias("volatility"),
        _zero(ratio((mean - risk_free / periods) * periods, vol)).alias("sharpe"), _zero(ratio((mean - risk_free / periods) * periods, down)).alias("sortino"),
        _zero(ratio(annual, -worst)).alias("calmar"), worst.alias("max_drawdown"), F.max("_under").alias("drawdown_duration"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), _zero(ratio(gain, loss)).alias("profit_factor"), _zero(ratio(mean_gain, mean_loss)).alias("win_loss"),
        F.avg(F.when(F.col("_rank") <= cut, F.col("r"))).alias("cvar"), status.alias("status"),
    )


def active_metrics(rows: DataFrame, *run: str, periods: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """Against a benchmark: ``r`` and ``b`` of the same periods."""
    a = F.col("r") - F.col("b")
    te = F.stddev_samp(a) * F.sqrt(F.lit(periods))
    beta = ratio(F.covar_samp("r", "b"), F.var_samp("b"))
    rf = risk_free / periods
    alpha = ((F.avg("r") - rf) - beta * (F.avg("b") - rf)) * periods
    up, down = F.col("b") > 0, F.col("b") < 0

    def capture(side: Column) -> Column:
        return _zero(ratio(F.exp(F.sum(F.when(side, F.log1p("r")))), F.exp(F.sum(F.when(side, F.log1p("b"))))))

    return rows.groupBy(*run).agg(
        (F.exp(F.sum(F.log1p("r")) - F.sum(F.log1p("b"))) - 1).alias("active_growth"), te.alias("tracking_error"), _zero(ratio(F.avg(a) * periods, te)).alias("information_ratio"),
        _zero(beta).alias("beta"), _zero(alpha).alias("alpha"), capture(up).alias("up_capture"), capture(down).alias("down_capture"),
    )


def return_ledger(periods: DataFrame, *run: str, tolerance: float = 1e-6) -> DataFrame:
    """Period returns with checks: continuity with the period before, and equity = start + PnL + flows."""
    w = Window.partitionBy(*run).orderBy("period_start")
    gap = (F.lag("period_end").over(w) != F.col("period_start")) | (F.abs(F.lag("ending_equity").over(w) - F.col("starting_equity")) > tolerance)
    expected = F.col("starting_equity") + F.col("net_pnl") + F.col("corporate_action_cash") + F.col("cash_interest") + F.col("external_cash_flow")
    status = (
        F.when(F.col("starting_equity") <= 0, "NON_POSITIVE_EQUITY").when(F.coalesce(gap, F.lit(False)), "DISCONTINUITY")
        .when(F.abs(F.col("net_pnl") - (F.col("executed_gross_pnl") - F.col("explicit_fees"))) > tolerance, "FEE_MISMATCH")
        .when(F.abs(expected - F.col("ending_equity")) > tolerance * F.greatest(F.lit(1.0), F.abs("ending_equity")), "IDENTITY").otherwise("OK")
    )
    r = (F.col("ending_equity") - F.col("external_cash_flow")) / F.nullif(F.col("starting_equity"), F.lit(0.0)) - 1
    return periods.withColumns({"period_return": r, "status": status})


def brinson(groups: DataFrame, *by: str) -> DataFrame:
    """Allocation, selection and interaction of each group; weights and returns of portfolio and benchmark given."""
    w = Window.partitionBy(*by)
    total_b = F.sum(F.col("wb") * F.col("rb")).over(w)
    out = groups.withColumn("_B", total_b)
    other = F.col("kind") != "EQUITY"
    effects = {
        "allocation": (F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("_B")), "selection": F.col("wb") * (F.col("rp") - F.col("rb")),
        "interaction": (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb")),
    }
    out = out.withColumns({k: F.when(other, 0.0).otherwise(v) for k, v in effects.items()} | {"other": F.when(other, F.col("wp") * F.col("rp") - F.col("wb") * F.col("rb") - (F.col("wp") - F.col("wb")) * F.col("_B")).otherwise(0.0)})
    return out.drop("_B")


def menchero(periods: DataFrame, effects: list[str]) -> DataFrame:
    """Effects of several periods linked to the compounded active return.

    ``periods``: period, rp, rb and the effects.  M is the mean growth factor,
    each period's coefficient M + C * active, C spreads the residual.
    """
    totals = periods.agg(F.count("*").alias("T"), (F.exp(F.sum(F.log1p("rp"))) - 1).alias("R"), (F.exp(F.sum(F.log1p("rb"))) - 1).alias("B"), F.sum(F.col("rp") - F.col("rb")).alias("a"), F.sum(F.pow(F.col("rp") - F.col("rb"), 2)).alias("a2"))
    t, big, base = F.col("T"), F.col("R"), F.col("B")
    m = F.when(F.abs(big - base) < 1e-12, F.pow(1 + big, (1 - t) / t)).otherwise((F.pow(1 + big, 1 / t) - F.pow(1 + base, 1 / t)) / F.nullif(big - base, F.lit(0.0)))
    totals = totals.withColumn("M", m).withColumn("C", F.when(F.col("a2") > 0, (big - base - F.col("M") * F.col("a")) / F.nullif(F.col("a2"), F.lit(0.0))).otherwise(0.0))
    rows = periods.crossJoin(F.broadcast(totals.select("M", "C")))  # one row
    beta = F.col("M") + F.col("C") * (F.col("rp") - F.col("rb"))
    return rows.withColumn("beta", beta).agg(*(F.sum(F.col("beta") * F.col(e)).alias(e) for e in effects), F.sum(F.col("beta") * (F.col("rp") - F.col("rb"))).alias("total"))


def shortfall(assets: DataFrame, fills: DataFrame) -> DataFrame:
    """Implementation shortfall of each asset: execution, fees, opportunity; paper less real is the sum.

    assets: symbol, target, begin_quantity, decision, end_mark; fills: symbol, side, quantity, price, fee.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    f = fills.withColumn("_q", signed).groupBy("symbol").agg(F.sum("_q").alias("traded"), F.sum(F.col("_q") * F.col("price")).alias("spent"), F.sum("fee").alias("fees"))
    j = assets.join(f, "symbol", "left").na.fill(0, ["traded", "spent", "fees"])
    end = F.col("begin_quantity") + F.col("traded")
    j = j.withColumns({
        "execution": F.col("spent") - F.col("decision") * F.col("traded"), "opportunity": (F.col("end_mark") - F.col("decision")) * (F.col("target") - end),
        "paper": (F.col("end_mark") - F.col("decision")) * F.col("target"),
        "net": (F.col("end_mark") - F.col("decision")) * F.col("begin_quantity") + F.col("end_mark") * F.col("traded") - F.col("spent") - F.col("fees"),
    })
    return j.withColumn("shortfall", F.col("execution") + F.col("fees") + F.col("opportunity")).withColumn("residual", F.col("paper") - F.col("net") - F.col("shortfall"))


def contribution(securities: DataFrame, fills: DataFrame) -> DataFrame:
    """Market PnL = end value - begin value - net purchases; net of fees and with action cash.

    securities: symbol, industry, begin_quantity, end_quantity, begin_mark, end_mark, action_cash.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    f = fills.groupBy("symbol").agg(F.sum(signed).alias("traded"), F.sum(signed * F.col("price")).alias("bought"), F.sum("fee").alias("fees"))
    j = securities.join(f, "symbol", "left").na.fill(0, ["traded", "bought", "fees"])
    market = F.col("end_quantity") * F.col("end_mark") - F.col("begin_quantity") * F.col("begin_mark") - F.col("bought")
    status = F.when(F.col("begin_quantity") + F.col("traded") == F.col("end_quantity"), "OK").otherwise("QUANTITY_MISMATCH")
    return j.withColumns({"market_pnl": market, "status": status}).withColumn("net_pnl", F.col("market_pnl") - F.col("fees") + F.col("action_cash"))


def factor_attribution(holdings: DataFrame, exposures: DataFrame, factors: DataFrame) -> DataFrame:
    """Contribution of each factor, and the specific rest, per period.

    holdings: period, symbol, weight, r, decision_at; exposures: symbol, factor,
    x, available_at; factors: period, factor, f.
    """
    x = holdings.join(exposures, "symbol").join(factors, ["period", "factor"])
    future = F.count_if(F.col("available_at") > F.col("decision_at"))
    by = x.groupBy("period", "factor").agg(F.sum(F.col("weight") * F.col("x") * F.col("f")).alias("contribution"), future.alias("n_future"))
    total = holdings.groupBy("period").agg(F.sum(F.col("weight") * F.col("r")).alias("total"))
    explained = by.groupBy("period").agg(F.sum("contribution").alias("explained"))
    specific = total.join(explained, "period").select("period", F.lit("SPECIFIC").alias("factor"), (F.col("total") - F.col("explained")).alias("contribution"), F.lit(0).cast("long").alias("n_future"))
    return by.unionByName(specific).withColumn("status", F.when(F.col("n_future") > 0, "FUTURE_DATA").otherwise("OK"))


def empirical_tail(losses: DataFrame, *run: str, level: float = 0.95) -> DataFrame:
    """VaR (first loss whose cumulated probability reaches the level) and expected shortfall of weighted losses.

    ``losses``: loss, p (summing to 1 in each run).
    """
    w = Window.partitionBy(*run).orderBy("loss").rangeBetween(Window.unboundedPreceding, 0)
    rows = losses.withColumn("_c", F.sum("p").over(w))
    var = rows.groupBy(*run).agg(F.min(F.when(F.col("_c") + 1e-12 >= level, F.col("loss"))).alias("var"))
    joined = losses.join(var, list(run)) if run else losses.crossJoin(F.broadcast(var))
    return joined.groupBy(*run).agg(F.first("var").alias("var"), (F.first("var") + F.sum(F.col("p") * F.greatest(F.col("loss") - F.col("var"), F.lit(0.0))) / (1 - level)).alias("es"))


def tail_backtest(rows: DataFrame, *run: str, level: float = 0.95) -> DataFrame:
    """Exceptions of a VaR forecast, transitions, and the likelihood ratios of Kupiec and Christoffersen.

    ``rows``: timestamp, r, var, es (losses positive).  p-values: see ``risk.chi2_p``.
    """
    hit = (-F.col("r") > F.col("var") + 1e-12).cast("int")
    before = F.lag("_h").over(Window.partitionBy(*run).orderBy("timestamp"))
    x = rows.withColumn("_h", hit).withColumn("_b", before)
    cells = x.groupBy(*run).agg(
        F.count("*").alias("n"), F.sum("_h").alias("exceptions"), F.count_if((F.col("_h") == 1) & (-F.col("r") > F.col("es"))).alias("es_violations"),
        *(F.count_if((F.col("_b") == a) & (F.col("_h") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)),
    )

    def ll(k: Column, p: Column) -> Column:
        return F.when(k == 0, 0.0).otherwise(k * F.ln(F.greatest(p, F.lit(1e-300))))

    n, k = F.col("n"), F.col("exceptions")
    kupiec = 2 * F.greatest(F.lit(0.0), ll(n - k, 1 - k / n) + ll(k, k / n) - ll(n - k, F.lit(level)) - ll(k, F.lit(1 - level)))
    n00, n01, n10, n11 = (F.col(f"n{a}{b}") for a in (0, 1) for b in (0, 1))
    p0, p1 = _zero(ratio(n01, (n00 + n01).cast("double"))), _zero(ratio(n11, (n10 + n11).cast("double")))
    p = _zero(ratio(n01 + n11, (n00 + n01 + n10 + n11).cast("double")))
    christoffersen = 2 * F.greatest(F.lit(0.0), ll(n00, 1 - p0) + ll(n01, p0) + ll(n10, 1 - p1) + ll(n11, p1) - ll(n00 + n10, 1 - p) - ll(n01 + n11, p))
    return cells.withColumns({"kupiec_lr": kupiec, "christoffersen_lr": christoffersen})


def period_positions(fills: DataFrame, length: int) -> DataFrame:
    """Fills as periods of ``length``: quantity at the begin and end of each period with a fill, cash paid and fees.

    ``fills``: timestamp, symbol, side, quantity, price, fee; a period holds begin <= timestamp < begin + length.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = fills.withColumn("period", F.expr(f"timestamp div {length}")).withColumn("_q", signed)
    out = rows.groupBy("symbol", "period").agg(F.sum("_q").alias("traded"), F.sum(F.col("_q") * F.col("price")).alias("paid"), F.sum("fee").alias("fees"))
    end = F.sum("traded").over(Window.partitionBy("symbol").orderBy("period"))
    return out.withColumn("end_quantity", end).withColumn("begin_quantity", F.col("end_quantity") - F.col("traded"))


def shortfall_inputs(orders: DataFrame, fills: DataFrame, marks: DataFrame) -> DataFrame:
    """Orders and what became of them, for ``shortfall``: ``symbol, timestamp, side, ordered, filled, decision, paid``.

    ``orders``: timestamp, symbol, side, quantity; ``fills``: decided_at, symbol, quantity, price; ``marks``: timestamp, symbol, close.
    """
    done = fills.groupBy(F.col("decided_at").alias("timestamp"), "symbol").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("paid"))
    out = orders.withColumnRenamed("quantity", "ordered").join(done, ["timestamp", "symbol"], "left").join(marks.select("timestamp", "symbol", F.col("close").alias("decision")), ["timestamp", "symbol"])
    return out.select("symbol", "timestamp", "side", "ordered", F.coalesce("filled", F.lit(0)).alias("filled"), "decision", F.coalesce("paid", F.lit(0.0)).alias("paid"))
