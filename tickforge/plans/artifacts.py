"""Stored artifacts, contracts, logs and comparisons of models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import rounded
from tickforge.operators import analytics as A
from tickforge.operators import backtest as B
from tickforge.operators import checks as C
from tickforge.operators import metrics as M
from tickforge.operators import models as Y
from tickforge.operators import risk as K
from tickforge.plans.common import FROM, SCORED, r, rounded_columns, scored
from tickforge.plans.feeds import _lake, _reports
from tickforge.plans.portfolio import _ORDERS, _RET, _orders, _returns, _scalars
from tickforge.sources import datasets
from tickforge.sources.cache import FileCache, FrameCache
from tickforge.sources.lake import ResultStore, scratch
from tickforge.sources.tables import BARS, FILLS, fills, monthly_bars, table
from tickforge.streaming import feed, log

YEAR = "CAST(year(to_timestamp(timestamp / 1000000000)) AS INTEGER)"


def _predictions(s, d):
    path = scratch(s, "predictions")
    scored(s, d).select("timestamp", "symbol", "score").write.parquet(path)
    return datasets.predictions(s, path)


def _ingested(s, d):
    """Rows of each generation: a known source adds none."""
    lake = _lake(s, d)
    out = None
    for k in (1, 2):
        part = lake.scan(lake.snapshot(k)).agg(F.lit(k).alias("generation"), F.lit(len(lake.snapshot(k)["sources"])).alias("n_sources"), F.count("*").alias("n"), F.sum("volume").alias("volume"))
        out = part if out is None else out.unionByName(part)
    return out


def _metrics(s, d):
    """The least value of each user is saved first, then the largest one of those with an even id replaces it."""
    store = ResultStore(s, scratch(s, "metrics"))
    users = table(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    store.save_metrics(1, users.select("run_id", F.col("least").alias("value")))
    store.save_metrics(2, users.filter("run_id % 2 = 0").select("run_id", F.col("most").alias("value")))
    return store.metrics().select("run_id", "value", "saved_at")


def _wal(s, d):
    """Reports as logs of eight shards, each torn in its last frame by a crash: what is recovered, and the orders replayed from it."""
    reports = _reports(s, d).withColumn("shard", F.pmod("order_id", F.lit(8)).cast("long"))
    rows = reports.select("shard", F.row_number().over(Window.partitionBy("shard").orderBy("order_id", "position")).cast("long").alias("n"), F.to_json(F.struct("order_id", "position", "exec_id", "status", "cumulative")).alias("payload"))
    segments = log.write(rows, "shard", 1000)
    last = F.col("segment") == F.max("segment").over(Window.partitionBy("shard"))
    crashed = segments.withColumn("content", F.when(last, log.torn(F.col("content"), 5)).otherwise(F.col("content")))
    found = log.read(crashed, "shard")
    replayed = found.select(F.from_json("payload", "order_id long, position int, exec_id string, status string, cumulative int").alias("x")).select("x.*")
    return feed.order_states(replayed).groupBy("status").agg(F.count("*").alias("n"), F.sum("duplicates").alias("duplicates"))


_WAL = (
    "WITH o AS (SELECT o_orderkey, o_custkey % 3 AS k, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_orderkey % 8) AS torn FROM orders)"
    " SELECT CASE WHEN k = 2 OR torn THEN 'PARTIAL' WHEN k = 0 THEN 'FILLED' ELSE 'CANCELED' END AS status, count(*) AS n, count(*) AS duplicates FROM o GROUP BY 1"
)


def _result_cache(s, d):
    """Two ranges of bars asked for four times, in a cache that holds both."""
    cache = FrameCache(1 << 40)
    rows = []
    try:
        for lo, hi in ((0, FROM), (FROM, 1 << 62), (0, FROM), (FROM, 1 << 62)):
            frame = cache.get((1, lo, hi, "timestamp,volume"), lambda lo=lo, hi=hi: monthly_bars(s, d).filter(F.col("timestamp").between(lo, hi - 1)).select("timestamp", "volume"))
            rows.append((lo, hi, *frame.agg(F.count("*"), F.sum("volume")).first(), cache.hits, cache.misses))
    finally:
        cache.clear()
    return s.createDataFrame(rows, "lo long, hi long, n long, volume long, hits int, misses int")


_CACHED = (
    BARS + f", q AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST({FROM} AS BIGINT), 0, 1), (CAST({FROM} AS BIGINT), CAST(4611686018427387904 AS BIGINT), 0, 2), (CAST(0 AS BIGINT), CAST({FROM} AS BIGINT), 1, 2), (CAST({FROM} AS BIGINT), CAST(4611686018427387904 AS BIGINT), 2, 2)) t(lo, hi, hits, misses))"
    " SELECT lo, hi, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, hits, misses FROM q JOIN bars ON timestamp >= lo AND timestamp < hi GROUP BY lo, hi, hits, misses"
)


def _bar_cache(s, d):
    """A folder of bars read twice, replaced by the later ones, and read again."""
    cache, path = FileCache(s, 1 << 40), scratch(s, "bars")
    bars = monthly_bars(s, d)
    rows = []
    try:
        for k, part in enumerate((bars, None, bars.filter(F.col("timestamp") >= FROM))):
            if part is not None:
                part.write.mode("overwrite").parquet(path)
            rows.append((k, cache.read(path).count(), cache.hits, cache.misses))
    finally:
        cache.clear()
    return s.createDataFrame(rows, "k int, n long, hits int, misses int")


def _enriched(s, d):
    reference = table(s, d, "supplier").filter("s_suppkey % 10 <> 3").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), "s_nationkey")
    return datasets.write_enriched(monthly_bars(s, d), reference, scratch(s, "enriched")).select("symbol", F.col("year").cast("int").alias("year"), "n", "first", "last", "unknown")


_ENRICHED = (
    BARS + f"""SELECT symbol, {YEAR} AS "year", count(*) AS n, min(timestamp) AS first, max(timestamp) AS last, count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey = CAST(symbol AS BIGINT))) AS unknown FROM bars GROUP BY 1, 2"""
)


def _windows(s, d):
    path = scratch(s, "windows")
    datasets.windows(scored(s, d), ["score", "relevance"], 5, "label").write.parquet(path)
    rows = s.read.parquet(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x[0])
    return rows.select("timestamp", "symbol", F.size("features").alias("length"), rounded(total, 5).alias("total"), F.element_at("features", 1)[1].cast("int").alias("oldest"), "label")


def _ledger(s, d):
    """A chain of digests over the events of each type; then one payload in a thousand is changed and one row in 997 taken out."""
    rows = table(s, d, "events").select("event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long").alias("seq"), "event_id", "value", F.to_json(F.struct("event_id", "value")).alias("payload"))

    def chain(pdf):
        import hashlib

        import pandas as pd

        pdf, before, links = pdf.sort_values("seq"), "0" * 64, []
        for payload in pdf["payload"]:
            digest = hashlib.sha256(f"{before}\n{payload}".encode()).hexdigest()
            links.append((before, digest))
            before = digest
        return pd.concat([pdf.reset_index(drop=True), pd.DataFrame(links, columns=["previous", "digest"])], axis=1)

    path = scratch(s, "ledger")
    rows.groupBy("event_type").applyInPandas(chain, "event_type string, seq long, event_id long, value double, payload string, previous string, digest string").write.parquet(path)
    ledger = s.read.parquet(path).filter("seq % 997 <> 0").withColumn("payload", F.when(F.col("seq") % 1000 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return C.ledger_status(ledger, "event_type").groupBy("event_type", "status").agg(F.count("*").alias("n"))


_LEDGER = (
    "WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events)"
    " SELECT event_type, CASE WHEN seq > 1 AND seq % 997 = 1 THEN 'BROKEN_LINK' WHEN seq % 1000 = 7 THEN 'BAD_DIGEST' ELSE 'OK' END AS status, count(*) AS n FROM e WHERE seq % 997 <> 0 GROUP BY 1, 2"
)


def _models_valid(x):
    cov = K.sample_cov(x)
    names = [f"s{k:03d}" for k in range(len(cov))]
    crooked, flat = cov.copy(), cov.copy()
    crooked[0, 1] += 1.0
    flat[0, 0] = 0.0
    cases = {"model": (names, cov, 1, 2), "late": (names, cov, 3, 2), "crooked": (names, crooked, 1, 2), "flat": (names, flat, 1, 2), "unsorted": (names[::-1], cov, 1, 2), "nan": (names, cov * np.nan, 1, 2)}
    expected = {"model": "OK", "late": "NOT_YET_KNOWN", "crooked": "NOT_SYMMETRIC", "flat": "BAD_VARIANCE", "unsorted": "BAD_NAMES", "nan": "NOT_FINITE"}
    return [(k, float(C.risk_model_status(*v) == expected[k])) for k, v in cases.items()]


def _oracle(x):
    """The first half estimates, the whole panel stands for the population."""
    population, sample = K.sample_cov(x), K.sample_cov(x[: len(x) // 2])
    return list(zip(("loss", "sample_loss", "prial"), K.oracle_loss(K.ledoit_wolf(x[: len(x) // 2])[0], sample, population), strict=True))


def _specs(s, d):
    o = table(s, d, "orders")
    spec = o.select((F.col("o_custkey") % 5 * 63.0).alias("periods_per_year"), (F.col("o_orderkey") % 7 / 2 - 1.5).alias("risk_free"), (F.col("o_custkey") % 11 / 10.0).alias("tail"), F.when(F.col("o_orderkey") % 13 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("initial"))
    return spec.select(C.performance_spec_status().alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _contracts(s, d):
    """Fifteen digests a supplier, some of them cut or in capitals."""
    names = [f"d{k:02d}" for k in range(15)]
    digest = {n: F.sha2(F.concat("s_name", F.lit(n)), 256) for n in names}
    digest["d03"] = F.when(F.col("s_suppkey") % 5 == 0, F.upper(digest["d03"])).otherwise(digest["d03"])
    digest["d11"] = F.when(F.col("s_suppkey") % 7 == 0, F.substring(digest["d11"], 1, 60)).otherwise(digest["d11"])
    rows = table(s, d, "supplier").select("s_suppkey", *(v.alias(k) for k, v in digest.items()), F.lit(1).alias("window_start"), (F.col("s_suppkey") % 4 + 1).alias("window_end"))
    return rows.select("s_suppkey", C.digests_status(names).alias("status"))


def _shortfalls(s, d):
    """Target orders, their fills at the next open and the close at the decision."""
    orders, bars = _orders(s, d), monthly_bars(s, d)
    at = bars.select("symbol", F.col("timestamp").alias("fill_at"), F.lag("timestamp").over(Window.partitionBy("symbol").orderBy("timestamp")).alias("decided_at"))
    done = B.next_open_fills(orders, bars).join(at, ["symbol", "fill_at"]).select("decided_at", "symbol", "quantity", "price")
    return A.shortfall_inputs(orders, done, bars)


_SHORTFALLS = (
    f"WITH {_ORDERS}, nb AS (SELECT symbol, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS timestamp, open, volume FROM bars),"
    " sf AS (SELECT od.symbol, od.timestamp, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS ordered, coalesce(least(abs(delta), CAST(floor(nb.volume * 0.25) AS BIGINT)), 0) AS filled, b.close AS decision,"
    " coalesce(nb.open * CASE WHEN delta > 0 THEN 1 + 10.0 / 1e4 ELSE 1 - 10.0 / 1e4 END, 0) AS price FROM od JOIN bars b USING (timestamp, symbol) LEFT JOIN nb ON nb.symbol = od.symbol AND nb.timestamp = od.timestamp)"
)

def _shortfall_rows(s, d):
    return _shortfalls(s, d).select("symbol", "timestamp", "side", "ordered", "filled", rounded(F.col("paid"), 3).alias("paid"))


def _shortfall_sums(s, d):
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    cost = F.sum(sign * (F.col("paid") - F.col("filled") * F.col("decision")))
    return _shortfalls(s, d).groupBy("symbol").agg(F.sum("ordered").alias("ordered"), F.sum("filled").alias("filled"), rounded(cost, 2).alias("execution"))


def _batches(s, d):
    return feed.coalesced(table(s, d, "events"), "event_type", ["ts", "event_id"], "user_id").groupBy("user_id").agg(F.count("*").alias("batches"), F.max("n").alias("longest"))


def _benchmark(s, d):
    """Correlation with the label by timestamp of each rule and of ridge: the paired deltas to ridge."""
    data = scored(s, d)
    w = Y.ridge(data, ["score"], "label")
    models = {"ridge": Y.linear(w, ["score"]), "momentum": F.col("score"), "reversal": -F.col("score"), "equal_weight": F.lit(0.0)}
    long = data.withColumns(models).unpivot(["timestamp", "symbol", "label"], list(models), "model", "s")
    ic = long.groupBy("model", "timestamp").agg(M.pearson(F.col("s"), F.col("label")).alias("ic"))
    base = ic.filter("model = 'ridge'").select("timestamp", F.col("ic").alias("base"))
    delta = F.col("ic") - F.col("base")
    return ic.join(base, "timestamp").groupBy("model").agg(F.count("*").alias("n"), rounded(F.avg("ic"), 5).alias("ic"), rounded(F.avg(delta), 5).alias("delta"), rounded(F.avg((delta > 1e-9).cast("double")), 5).alias("wins"))


_BENCHMARK = (
    SCORED
    + ", s AS (SELECT count(*) AS n, sum(score) AS sx, sum(label) AS sy, sum(score * score) + 1.0 AS sxx, sum(score * label) AS sxy FROM scored),"
    " b AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM s),"
    " m AS (SELECT timestamp, label, unnest(['ridge', 'momentum', 'reversal', 'equal_weight']) AS model, unnest([score * b, score, -score, 0.0]) AS s FROM scored, b),"
    " i AS (SELECT model, timestamp, CASE WHEN stddev_pop(s) * stddev_pop(label) <= 1e-15 THEN 0.0 ELSE covar_pop(s, label) / (stddev_pop(s) * stddev_pop(label)) END AS ic FROM m GROUP BY 1, 2),"
    " p AS (SELECT i.*, ic - base AS delta FROM i JOIN (SELECT timestamp, ic AS base FROM i WHERE model = 'ridge') USING (timestamp))"
    f" SELECT model, count(*) AS n, {r('avg(ic)', 5)} AS ic, {r('avg(delta)', 5)} AS delta, {r('avg(CASE WHEN delta > 1e-9 THEN 1.0 ELSE 0 END)', 5)} AS wins FROM p GROUP BY 1"
)


def _periods(s, d, k=5, bps=10.0):
    """Top-k rebalance at every timestamp: return net of ``bps`` on what is traded, half of both sides."""
    top = M.top_k(scored(s, d), k).select("timestamp", "symbol", "label")
    times = top.select("timestamp").distinct().withColumn("nth", F.row_number().over(Window.orderBy("timestamp")))  # one row a timestamp
    held = top.join(times, "timestamp")
    before = held.select((F.col("nth") + 1).alias("nth"), "symbol", F.lit(1).alias("kept"))
    rows = held.join(before, ["nth", "symbol"], "left").groupBy("timestamp", "nth").agg(F.avg("label").alias("gross"), (F.count("*") - F.count("kept")).alias("new"), F.count("*").alias("n"))
    return rows.select("timestamp", "nth", (F.col("gross") - F.col("new") / F.col("n") * 2 * bps / 1e4).alias("r"))


_PERIODS = (
    SCORED
    + ", tk AS (SELECT timestamp, symbol, label FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol) AS k FROM scored) WHERE k <= 5),"
    " ti AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS nth FROM (SELECT DISTINCT timestamp FROM tk)), hd AS (SELECT * FROM tk JOIN ti USING (timestamp)),"
    " pr AS (SELECT h.timestamp, h.nth, avg(h.label) - (count(*) - count(b.symbol)) * 1.0 / count(*) * 2 * 10.0 / 1e4 AS r FROM hd h LEFT JOIN hd b ON b.nth = h.nth - 1 AND b.symbol = h.symbol GROUP BY 1, 2)"
)


def _tail_of(rows, *by, level=0.9):
    losses = rows.select(*by, (-F.col("r")).alias("loss"), (1 / F.count("*").over(Window.partitionBy(*by))).alias("p"))
    return A.empirical_tail(losses, *by, level=level)


def _proxy(s, d):
    """The fold of the net period returns (growth, worst drawdown) and their tail; one row a timestamp goes in."""
    rows = _periods(s, d)
    w = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    equity = rows.withColumn("e", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("dd", 1 - F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)))
    fold = equity.agg(F.count("*").alias("n"), F.max_by("e", "timestamp").alias("growth"), F.max("dd").alias("drawdown"))
    return rounded_columns(fold.crossJoin(F.broadcast(_tail_of(rows))), 5)


_PROXY = (
    _PERIODS
    + ", eq AS (SELECT timestamp, r, exp(sum(ln(1 + r)) OVER (ORDER BY timestamp)) AS e FROM pr), dr AS (SELECT *, 1 - e / greatest(max(e) OVER (ORDER BY timestamp), 1.0) AS dd FROM eq),"
    " l AS (SELECT -r AS loss, 1.0 / count(*) OVER () AS p FROM pr), c AS (SELECT *, sum(p) OVER (ORDER BY loss RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM l), v AS (SELECT min(loss) FILTER (c + 1e-12 >= 0.9) AS v FROM c),"
    " t AS (SELECT max(v) AS var, max(v) + sum(p * greatest(loss - v, 0)) / 0.1 AS es FROM l, v)"
    f" SELECT count(*) AS n, {r('arg_max(e, timestamp)', 5)} AS growth, {r('max(dd)', 5)} AS drawdown, {r('any_value(var)', 5)} AS var, {r('any_value(es)', 5)} AS es FROM dr, t"
)


def _binding(s, d):
    """VaR and expected shortfall of the return vector of each symbol at the bindings' level."""
    return rounded_columns(_tail_of(_returns(s, d).select("symbol", "r"), "symbol", level=0.95), 4)


def _ablation(s, d):
    """Seed x group x slippage: returns of the top 5 by score with noise of a seed, with and without the size, paired with the whole model."""
    size = table(s, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("s_acctbal") / 1e6).alias("size"))
    base = scored(s, d).join(size, "symbol")
    noise = F.pmod(F.col("symbol").cast("long") * F.col("seed") * 7919, F.lit(1000)) / 1e5
    grid = base.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("group", F.explode(F.array(F.lit("all"), F.lit("without_size"))))
    rows = grid.withColumn("s", F.col("score") + noise + F.when(F.col("group") == "all", F.col("size")).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy("seed", "group", "timestamp").orderBy(F.desc("s"), "symbol"))
    by_time = rows.withColumn("k", best).filter("k <= 5").groupBy("seed", "group", "timestamp").agg(F.avg("label").alias("r"))
    whole = by_time.filter("group = 'all'").select("seed", "timestamp", F.col("r").alias("whole"))
    paired = by_time.filter("group <> 'all'").join(whole, ["seed", "timestamp"]).withColumn("slippage", F.explode(F.array(F.lit(0.0), F.lit(10.0))))
    cost = F.col("slippage") / 1e4
    return paired.groupBy("seed", "group", "slippage").agg(F.count("*").alias("n"), rounded(F.avg(F.col("r") - cost)).alias("r"), rounded(F.avg(F.col("r") - F.col("whole"))).alias("delta"))


_ABLATION = (
    SCORED
    + ", g AS (SELECT timestamp, symbol, label, seed, grp, score + (CAST(symbol AS BIGINT) * seed * 7919) % 1000 / 1e5 + CASE WHEN grp = 'all' THEN s_acctbal / 1e6 ELSE 0 END AS s FROM scored JOIN supplier ON s_suppkey = CAST(symbol AS BIGINT), (VALUES (1), (2), (3)) a(seed), (VALUES ('all'), ('without_size')) b(grp)),"
    " t AS (SELECT seed, grp, timestamp, avg(label) AS r FROM (SELECT *, row_number() OVER (PARTITION BY seed, grp, timestamp ORDER BY s DESC, symbol) AS k FROM g) WHERE k <= 5 GROUP BY 1, 2, 3)"
    f' SELECT x.seed, x.grp AS "group", CAST(slippage AS DOUBLE) AS slippage, count(*) AS n, {r("avg(x.r - slippage / 1e4)")} AS r, {r("avg(x.r - w.r)")} AS delta FROM t x JOIN t w ON w.seed = x.seed AND w.timestamp = x.timestamp AND w.grp = $$all$$, (VALUES (0.0), (10.0)) v(slippage) WHERE x.grp <> $$all$$ GROUP BY 1, 2, 3'
)


def _gate(s, d):
    """Reversal as the candidate against momentum: paired bootstrap of the correlations, and under stress (scores of half the symbols turned)."""
    x = scored(s, d)
    turned = F.when(F.col("symbol").cast("long") % 2 == 0, F.col("score")).otherwise(-F.col("score"))
    rows = x.groupBy("timestamp").agg((-M.pearson(F.col("score"), F.col("label"))).alias("candidate"), M.pearson(F.col("score"), F.col("label")).alias("baseline"), (-M.pearson(turned, F.col("label"))).alias("stressed"))
    return rounded_columns(Y.gate_candidate(rows, block=4.0, draws=299, seed=7, margin=0.02, stress_margin=0.5))


QUERIES = {
    "src_predictions": (_predictions, f"WITH {SCORED} SELECT timestamp, symbol, score FROM scored"),
    "snk_ingest_many": (
        _ingested,
        f"WITH {BARS} SELECT 1 AS generation, 1 AS n_sources, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE timestamp < {FROM} UNION ALL SELECT 2, 2, count(*), CAST(sum(volume) AS BIGINT) FROM bars",
    ),
    "snk_metrics_upsert": (_metrics, "SELECT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN max(value) ELSE min(value) END AS value, CAST(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS saved_at FROM events GROUP BY user_id"),
    "snk_enriched_dataset": (_enriched, f"WITH {_ENRICHED}"),
    "snk_dataset_npz": (
        _windows,
        f"WITH {SCORED}, w AS (SELECT timestamp, symbol, label, list(score) OVER x AS f, first_value(relevance) OVER x AS oldest FROM scored WINDOW x AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
        f" SELECT timestamp, symbol, 5 AS length, {r('list_sum(f)', 5)} AS total, oldest, label FROM w WHERE len(f) = 5",
    ),
    "meta_result_cache": (_result_cache, f"WITH {_CACHED}"),
    "meta_bar_cache": (
        _bar_cache,
        f"WITH {BARS} SELECT 0 AS k, count(*) AS n, 0 AS hits, 1 AS misses FROM bars UNION ALL SELECT 1, count(*), 1, 1 FROM bars UNION ALL SELECT 2, count(*), 1, 2 FROM bars WHERE timestamp >= {FROM}",
    ),
    "st_wal": (_wal, _WAL),
    "st_window_store": (
        lambda s, d: feed.feature_windows(monthly_bars(s, d).select("symbol", "timestamp", F.col("volume").cast("double").alias("x")), 20),
        f"WITH {BARS} SELECT symbol, timestamp, CAST(count(*) OVER w AS INTEGER) AS size, min(timestamp) OVER w AS oldest, CAST(sum(volume) OVER w AS DOUBLE) AS total FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    ),
    "st_batch_runner": (
        _batches,
        "WITH e AS (SELECT user_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS fresh, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e), n AS (SELECT user_id, b, count(*) AS n FROM b GROUP BY 1, 2) SELECT user_id, count(*) AS batches, max(n) AS longest FROM n GROUP BY 1",
    ),
    "audit_frozen_ledger": (_ledger, _LEDGER),
    "pm_risk_model_valid": (_scalars(_models_valid), None),
    "pm_cov_oracle": (_scalars(_oracle), None),
    "pa_spec_valid": (
        _specs,
        "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'BAD_PERIODS' WHEN o_orderkey % 7 / 2.0 - 1.5 <= -1 THEN 'BAD_RISK_FREE' WHEN o_custkey % 11 = 0 OR o_custkey % 11 = 10 THEN 'BAD_TAIL' WHEN o_orderkey % 13 = 0 OR o_totalprice <= 0 THEN 'BAD_CAPITAL' ELSE 'OK' END AS status, count(*) AS n FROM orders GROUP BY 1",
    ),
    "pa_drift_contract": (_contracts, "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'EMPTY_WINDOW' WHEN s_suppkey % 5 = 0 AND upper(sha256(s_name || 'd03')) <> sha256(s_name || 'd03') THEN 'BAD_DIGEST_D03' WHEN s_suppkey % 7 = 0 THEN 'BAD_DIGEST_D11' ELSE 'OK' END AS status FROM supplier"),
    "pa_period_sink": (
        lambda s, d: A.period_positions(fills(s, d), 7_776_000_000_000_000).select("symbol", "period", "begin_quantity", "end_quantity", rounded(F.col("paid"), 2).alias("paid"), rounded(F.col("fees"), 2).alias("fees")),
        f"WITH {FILLS}, p AS (SELECT symbol, timestamp // 7776000000000000 AS period, CAST(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS q, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END * price) AS paid, sum(fee) AS fees FROM fills GROUP BY 1, 2), e AS (SELECT *, CAST(sum(q) OVER (PARTITION BY symbol ORDER BY period) AS BIGINT) AS e FROM p)"
        f" SELECT symbol, period, e - q AS begin_quantity, e AS end_quantity, {r('paid', 2)} AS paid, {r('fees', 2)} AS fees FROM e",
    ),
    "pa_shortfall_adapter": (_shortfall_rows, f"{_SHORTFALLS} SELECT symbol, timestamp, side, ordered, filled, {r('filled * price', 3)} AS paid FROM sf"),
    "pa_shortfall_sink": (
        _shortfall_sums,
        f"{_SHORTFALLS} SELECT symbol, CAST(sum(ordered) AS BIGINT) AS ordered, CAST(sum(filled) AS BIGINT) AS filled, {r('sum(CASE side WHEN $$BUY$$ THEN 1 ELSE -1 END * (filled * price - filled * decision))', 2)} AS execution FROM sf GROUP BY 1",
    ),
    "eval_benchmark": (_benchmark, f"WITH {_BENCHMARK}"),
    "eval_portfolio_ablation": (_ablation, f"WITH {_ABLATION}"),
    "eval_gate_candidate": (_gate, None),
    "bt_proxy_replay": (_proxy, f"WITH {_PROXY}"),
    "bt_empirical_cvar_binding": (
        _binding,
        f"WITH {_RET}, l AS (SELECT symbol, -r AS loss, 1.0 / count(*) OVER (PARTITION BY symbol) AS p FROM ret), c AS (SELECT *, sum(p) OVER (PARTITION BY symbol ORDER BY loss RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM l), v AS (SELECT symbol, min(loss) FILTER (c + 1e-12 >= 0.95) AS v FROM c GROUP BY 1) SELECT symbol, {r('max(v)', 4)} AS var, {r('max(v) + sum(p * greatest(loss - v, 0)) / 0.05', 4)} AS es FROM l JOIN v USING (symbol) GROUP BY 1",
    ),
    "date_time": (
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.weekday("o_orderdate").alias("w"),
            F.last_day("o_orderdate").alias("l"), F.date_add("o_orderdate", 30).alias("a"), F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate").alias("n"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("t"),
        ),
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y-%m') AS m, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS w, last_day(o_orderdate) AS l, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS a, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS n, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS t FROM orders",
    ),
    "json": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(F.concat(F.lit("["), "props", F.lit("]"))).alias("n"), F.get_json_object(F.to_json(F.struct("event_type", "value")), "$.event_type").alias("t")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_array_length('[' || props || ']') AS INTEGER) AS n, json_extract_string(to_json({'event_type': event_type, 'value': value}), '$.event_type') AS t FROM events",
    ),
}
