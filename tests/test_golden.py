"""Hand-checkable cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import analytics as A
from tickforge.operators import audit as U
from tickforge.operators import backtest as B
from tickforge.operators import drift as D
from tickforge.operators import labels as L
from tickforge.operators import metrics as M
from tickforge.operators import risk as K
from tickforge.operators import scan as S
from tickforge.operators import temporal as T
from tickforge.sources import files
from tickforge.sources.lake import Lake, ResultStore
from tickforge.streaming import feed

DAY = 86_400_000_000_000


def bar(p, volume=40):
    return {"open": p, "high": p, "low": p, "close": p, "volume": volume}


def run(plan, prices, rules, actions=None, volume=40):
    engine = B.Engine(rules, lambda ts, *_: plan.get(ts, []))
    for t, p in enumerate(prices, 1):
        engine.step(t, {"A": bar(p, volume)}, (actions or {}).get(t, []))
    return engine, engine.finish()


def test_partial_fills_round_trip():
    plan = {1: [{"symbol": "A", "side": "BUY", "quantity": 15}], 3: [{"symbol": "A", "side": "SELL", "quantity": 15}]}
    engine, out = run(plan, [10, 11, 12, 13, 14], B.Rules(cash=10_000))
    assert [(f["quantity"], round(f["price"], 9)) for f in out["fill"]] == [(10, 11.011), (5, 12.012), (10, 12.987), (5, 13.986)]
    assert engine.cash == pytest.approx(10029.445015) and len(out["round_trip"]) == 2
    assert sum(t["net_pnl"] for t in out["round_trip"]) == pytest.approx(29.445015)
    equity = [e["equity"] for e in out["equity"]]
    peaks = np.maximum.accumulate([10_000, *equity])[1:]
    assert max(1 - e / p for e, p in zip(equity, peaks, strict=True)) == pytest.approx(0.0000165055, abs=1e-9)


def test_split_with_dividend_and_limit_order():
    plan = {1: [{"symbol": "A", "side": "BUY", "quantity": 100}, {"symbol": "A", "side": "BUY", "quantity": 50, "limit": 9.5}]}
    engine, out = run(plan, [10, 10, 9.5, 5], B.Rules(cash=10_000, participation=1, slippage_bps=0, fee_rate=0), {4: [{"symbol": "A", "cash_dividend_per_share": 0.1, "share_multiplier": 2.0}]}, 1000)
    assert [(f["quantity"], f["price"]) for f in out["fill"]] == [(100, 10), (50, 9.5)]
    p = engine.positions["A"]
    assert p.quantity == 300 and engine.cash == pytest.approx(10_000 - 1000 - 475 + 15) and p.cost == pytest.approx((1000 + 475) / 300)


def test_rejections_and_expiry():
    plan = {1: [{"symbol": "A", "side": "SELL", "quantity": 5}, {"symbol": "A", "side": "BUY", "quantity": 0}, {"symbol": "Z", "side": "BUY", "quantity": 1}, {"symbol": "A", "side": "BUY", "quantity": 10**9}, {"symbol": "A", "side": "BUY", "quantity": 1, "limit": 1.0}]}
    _, out = run(plan, [10, 11], B.Rules(cash=100))
    assert [(o["status"], o["reason"]) for o in out["order"]] == [("REJECTED", "INSUFFICIENT_POSITION"), ("REJECTED", "INVALID_ORDER"), ("REJECTED", "UNKNOWN_SYMBOL"), ("REJECTED", "INSUFFICIENT_CASH"), ("EXPIRED", "")]
    engine = B.Engine(B.Rules(), lambda *_: [])
    engine.step(2, {})
    with pytest.raises(ValueError):
        engine.step(2, {})


def test_open_orders_reserve_cash_and_shares():
    buy = {"symbol": "A", "side": "BUY", "quantity": 60}
    engine, out = run({1: [buy, buy], 3: [{"symbol": "A", "side": "SELL", "quantity": 40, "limit": 99.0}] * 2}, [10, 10, 10, 10], B.Rules(cash=1000, participation=1, slippage_bps=0), volume=1000)
    assert [(o["side"], o["status"], o["reason"]) for o in out["order"]] == [
        ("BUY", "REJECTED", "INSUFFICIENT_CASH"), ("BUY", "FILLED", ""), ("SELL", "REJECTED", "INSUFFICIENT_POSITION"), ("SELL", "EXPIRED", ""),
    ]
    assert engine.reserved == pytest.approx(0) and engine.promised["A"] == 0


def test_cash_is_checked_again_at_the_fill():
    _, out = run({1: [{"symbol": "A", "side": "BUY", "quantity": 90}]}, [10, 12], B.Rules(cash=1000, participation=1), volume=1000)
    assert not out["fill"] and [(o["status"], o["reason"]) for o in out["order"]] == [("REJECTED", "INSUFFICIENT_CASH")]
    _, out = run({1: [{"symbol": "A", "side": "BUY", "quantity": 90}]}, [10, 10, 40], B.Rules(cash=1000, participation=1), volume=50)
    assert [f["quantity"] for f in out["fill"]] == [50] and [(o["status"], o["left"]) for o in out["order"]] == [("CANCELED", 40)]


def test_close_mode_fills_on_the_bar_and_the_rest_at_the_next_open():
    engine, out = run({1: [{"symbol": "A", "side": "BUY", "quantity": 30}, {"symbol": "A", "side": "BUY", "quantity": 5, "limit": 9.0}]}, [10, 12, 8], B.Rules(cash=1000, participation=1, slippage_bps=0, fee_rate=0, fill_timing="CLOSE"), volume=20)
    assert [(f["timestamp"], f["quantity"], f["price"]) for f in out["fill"]] == [(1, 20, 10), (2, 10, 12), (3, 5, 8)]
    assert engine.cash == 1000 - 200 - 120 - 40


@pytest.mark.parametrize("seed", range(8))
def test_engine_invariants(seed):
    rng = np.random.default_rng(seed)
    plan = {t: [{"symbol": "A", "side": rng.choice(["BUY", "SELL"]), "quantity": int(rng.integers(1, 80)), **({"limit": float(rng.uniform(8, 12))} if rng.random() < 0.4 else {})}] for t in range(1, 60)}
    engine, out = run(plan, rng.uniform(8, 12, 60), B.Rules(cash=3000, participation=float(rng.uniform(0.1, 1))), volume=int(rng.integers(5, 100)))
    flow = sum((1 if f["side"] == "SELL" else -1) * f["quantity"] * f["price"] - f["fee"] for f in out["fill"])
    assert engine.cash == pytest.approx(3000 + flow) and engine.cash >= -1e-6
    held = sum((1 if f["side"] == "BUY" else -1) * f["quantity"] for f in out["fill"])
    assert held == sum(p.quantity for p in engine.positions.values()) >= 0


def test_brinson(spark):
    rows = spark.createDataFrame([(1, "EQUITY", 0.6, 0.5, 0.10, 0.06), (2, "EQUITY", 0.4, 0.5, 0.05, 0.04)], "id int, kind string, wp double, wb double, rp double, rb double")
    one, two = A.brinson(rows).orderBy("id").collect()
    assert [one.allocation, one.selection, one.interaction] == pytest.approx([0.001, 0.02, 0.004])
    assert two.allocation + two.selection + two.interaction == pytest.approx(0.005)


def test_menchero_links_to_the_compounded_return(spark):
    rows = spark.createDataFrame([(1, 0.05, 0.03, 0.01, 0.01), (2, -0.02, 0.01, -0.02, -0.01), (3, 0.04, 0.0, 0.03, 0.01)], "period int, rp double, rb double, a double, s double")
    out = A.menchero(rows, ["a", "s"]).first()
    expected = 1.05 * 0.98 * 1.04 - 1.03 * 1.01
    assert out.total == pytest.approx(expected) and out.a + out.s == pytest.approx(expected)


def test_shortfall_and_contribution(spark):
    assets = spark.createDataFrame([("X", 100, 0, 10.0, 11.0)], "symbol string, target long, begin_quantity long, decision double, end_mark double")
    fills = spark.createDataFrame([("X", "BUY", 100, 10.1, 1.0)], "symbol string, side string, quantity long, price double, fee double")
    r = A.shortfall(assets, fills).first()
    assert [r.execution, r.fees, r.opportunity, r.shortfall, r.paper, r.net, r.residual] == pytest.approx([10, 1, 0, 11, 100, 89, 0])
    sec = spark.createDataFrame([("X", "i", 10, 0, 10.0, 12.0, 2.0)], "symbol string, industry string, begin_quantity long, end_quantity long, begin_mark double, end_mark double, action_cash double")
    sold = spark.createDataFrame([("X", "SELL", 10, 11.0, 1.0)], "symbol string, side string, quantity long, price double, fee double")
    c = A.contribution(sec, sold).first()
    assert (c.market_pnl, c.net_pnl, c.status) == (10.0, 11.0, "OK")


def test_empirical_tail(spark):
    rows = spark.createDataFrame([(-r, 0.25) for r in (-3.0, -1.0, 1.0, 2.0)], "loss double, p double")
    assert tuple(A.empirical_tail(rows, level=0.75).first()) == pytest.approx((1.0, 3.0))


def test_kernels():
    assert K.risk_budget(np.diag([1.0, 4.0])) == pytest.approx([2 / 3, 1 / 3])
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6))
    cov = K.sample_cov(x)
    assert K.risk_contributions(K.risk_budget(cov), cov) == pytest.approx([1 / 6] * 6, abs=1e-6)
    for w in (K.hrp(cov), K.min_variance(cov), K.nco(cov, K.onc(cov)), K.mean_variance(x.mean(0), cov, 3, 0.5)):
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()
    w = K.min_variance(cov)
    assert all(w @ cov @ w <= v @ cov @ v + 1e-9 for v in rng.dirichlet(np.ones(6), 200))
    shrunk, delta = K.ledoit_wolf(x)
    assert 0 <= delta <= 1 and np.diag(shrunk) == pytest.approx(np.diag(cov))
    assert np.diag(K.denoise(cov, 200)) == pytest.approx(np.diag(cov))
    p = K.entropy_tilt(np.full(200, 1 / 200), x[:, :2], x[:, :2].mean(0) + 0.1)
    assert p @ x[:, :2] == pytest.approx(x[:, :2].mean(0) + 0.1) and p.sum() == pytest.approx(1)
    mu, post = K.black_litterman(np.zeros(6), cov, np.eye(6)[:1], np.array([0.5]), np.array([1.0]))
    assert mu[0] == pytest.approx(0.5) and post[0, 0] == pytest.approx(0, abs=1e-9)
    assert K.chi2_p(3.841458821) == pytest.approx(0.05, abs=1e-6)
    assert K.block_bootstrap(np.full(50, 1.0), 5, 99, 1) == (1.0, 0.01)
    assert K.expectile(x[:, 0], 0.5) == pytest.approx(x[:, 0].mean(), abs=1e-6)
    _, alpha, beta = K.garch(rng.standard_normal(300))
    assert alpha > 0 and alpha + beta < 1
    assert K.linear_cka(x, x) == pytest.approx(1) and K.mmd(x, x) == pytest.approx(0, abs=1e-12)


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", t) for t in range(0, 100, 7)] + [("b", 5)], "symbol string, timestamp long")
    right = spark.createDataFrame([("a", t, t * 2) for t in range(0, 100, 10)], "symbol string, known_at long, v long")
    for r in T.asof(left, right, "timestamp", "known_at").collect():
        known = [t for t in range(0, 100, 10) if t <= r.timestamp] if r.symbol == "a" else []
        assert r.known_at_asof == (max(known) if known else None) and r.v == (2 * max(known) if known else None)


def test_interval_and_sessions(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 1, 5, 9, 10, 50)], "symbol string, timestamp long")
    right = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, 10, "y"), ("a", 20, None, "z")], "symbol string, effective_from long, effective_to long, s string")
    want = {0: None, 1: "x", 5: "y", 9: "y", 10: None, 50: "z"}
    assert {r.timestamp: r.s for r in T.interval(left, right, ["symbol"]).collect()} == want
    assert {r.timestamp: r.s for r in T.interval_asof(left, right, "symbol").collect()} == want
    assert T.overlaps(right, ["symbol"]).count() == 0
    minutes = spark.createDataFrame([(9 * 60 + 31,), (15 * 60,), (12 * 60,), (9 * 60 + 30,), (11 * 60 + 30,)], "m int")
    assert [r[0] for r in minutes.select(S.session_of(F.col("m"))).collect()][:3] == ["MORNING", "CLOSING_AUCTION", None]
    assert [r[0] for r in minutes.select(S.session_of(F.col("m"), end_labelled=False)).collect()][3:] == ["MORNING", None]


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, y int")
    for f in (M.auc, M.auc_by_value):
        assert f(df).first().auc == pytest.approx(4.5 / 6)
    assert M.auc(df.filter("y = 1")).first().auc == 0.5
    flat = spark.createDataFrame([(1, s, 1.0, float(i), i) for i, s in enumerate("abc")], "timestamp long, symbol string, score double, label double, relevance int")
    assert M.regression(flat).first().ic == 0.0
    # all scores tie: every document gets the mean discount of the first two places
    discount = (1 + 1 / np.log2(3)) / 3
    assert M.ndcg_tied(flat, 2).first().ndcg == pytest.approx((1 + 3) * discount / (3 + 1 / np.log2(3)))


def test_step_up(spark):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "id string, p double")
    assert [round(r.q, 6) for r in D.adjusted(df).orderBy("id").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_windows_do_not_overlap():
    parts = L.windows(60, 20, 5, 5, 5, 2, 1)
    for k in {p[0] for p in parts}:
        (_, _, _, a), (_, _, b, c), (_, _, d, e) = [p for p in parts if p[0] == k]
        assert a + 3 <= b and c + 3 <= d and e <= 60
    with pytest.raises(ValueError):
        L.windows(10, 20, 5, 5, 5, 0, 0)


def bars(spark, n=20, start=1):
    return spark.createDataFrame([(start * DAY + t * DAY, s, 10.0, 11.0, 9.0, 10.5, 5) for t in range(n) for s in ("000001", "000002")], files.BARS)


def test_lake(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake", buckets=4)
    assert lake.scan().count() == 0 and lake.summary()["n_rows"] == 0
    first = lake.ingest(bars(spark))
    assert lake.ingest(bars(spark)) == first  # the same source again
    lake.ingest(bars(spark, 5, 100))
    assert lake.scan().count() == 50 and lake.scan(lake.snapshot(1)).count() == 40
    assert lake.scan(symbols="000002", start=100 * DAY).count() == 5
    assert lake.summary()["first_ts"] == DAY and lake.lineage() != lake.lineage(lake.snapshot(1))
    with pytest.raises(ValueError, match="known_keys"):
        lake.ingest(bars(spark, 1).withColumn("close", F.lit(10.6)))
    with pytest.raises(ValueError, match="bad_range"):
        lake.ingest(bars(spark, 1, 500).withColumn("high", F.lit(1.0)))
    assert lake.summary()["generation"] == 2
    with pytest.raises(RuntimeError):
        lake._write("gen-00000002.json", json.dumps({}))


def test_scan_reaches_the_files(spark, tmp_path):
    bars(spark).write.parquet(f"{tmp_path}/b")
    df = S.query(spark.read.parquet(f"{tmp_path}/b"), ["000001"], DAY, 5 * DAY, ["timestamp", "close"], ordered=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "EqualTo(symbol,000001)" in plan.replace("In(symbol, [000001])", "EqualTo(symbol,000001)") and "open" not in plan.split("ReadSchema")[1]


def test_result_store(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1,)], "x int")
    store.persist("good", 1, trades=rows)
    with pytest.raises(ValueError):
        store.persist("bad", 2, nonsense=rows)
    store._status("broken", "RUNNING", 9)
    rows.withColumn("run_id", F.lit("broken")).write.mode("append").partitionBy("run_id").parquet(f"{store.root}/trades")
    assert [r.run_id for r in store.read("trades").collect()] == ["good"] and store.runs().first().run_id == "broken"


def test_reference_rows(spark):
    rows = spark.createDataFrame([("Yes", "3.0", '{"size": 1.5}'), (" f ", "", None)], "a string, b string, c string")
    out = files.reference_rows(rows, {"a": "boolean", "b": "long", "c": "map"}).collect()
    assert [tuple(r) for r in out] == [(True, 3, {"size": 1.5}), (False, None, None)]
    with pytest.raises(Exception, match="maybe"):
        files.reference_rows(spark.createDataFrame([("maybe",)], "a string"), {"a": "boolean"}).collect()


def test_wire_round_trip():
    rows = [{"kind": "Q", "sequence": 1, "timestamp": 2, "symbol": "AB", "bid": 10.25, "ask": 10.5, "bid_size": 3, "ask_size": 4}, {"kind": "H", "sequence": 2, "timestamp": 3}, {"kind": "T", "sequence": 3, "timestamp": 4, "symbol": "LONGNAME", "price": 9.9999, "size": 7, "side": "S"}]
    data = feed.encode(rows)
    found, rest = feed.decode(data[:-1])
    assert len(found) == 2 and rest
    found, rest = feed.decode(data)
    assert rest == b"" and found[0][3:8] == ("AB", 10.25, 10.5, 3, 4) and found[2][8:] == (9.9999, 7, "S")
    with pytest.raises(ValueError):
        feed.decode(b"X" + data[1:])


def test_reorder_window():
    r = feed.Reorder(4)
    out = [s for q in (1, 3, 2, 2, 1, 5, 20, 21) for s, _ in r.push(q, None)]
    assert out == [1, 2, 3, 5, 20, 21] and r.counts == {"late": 2, "duplicate": 0, "gaps": 15, "resync": 1}



def _run(df, path, mode):
    q = df.writeStream.format("memory").queryName(f"q{abs(hash(path))}").option("checkpointLocation", f"{path}/ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {q.name}").collect()


def test_stream_equals_batch(spark, tmp_path):
    import time

    schema = "feed string, sequence long, arrival long"
    batches = [[("a", 1, 1), ("a", 4, 2), ("b", 7, 3)], [("a", 2, 4), ("a", 3, 5), ("b", 8, 6)], [("a", 90, 7), ("b", 7, 8)]]
    for i, part in enumerate(batches):  # files in order of their time
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted((r.feed, r.sequence, r.position) for r in _run(feed.reorder_stream(stream), str(tmp_path), "append"))
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert got == sorted((r.feed, r.sequence, r.position) for r in feed.reorder(whole).collect())


def test_order_stream_equals_replay(spark, tmp_path):
    schema = "order_id long, position int, exec_id string, status string, cumulative int"
    rows = [(1, 0, "e0", "ACCEPTED", 0), (1, 1, "e1", "PARTIAL", 5), (1, 2, "e1", "PARTIAL", 5), (1, 3, "e2", "PARTIAL", 3), (1, 4, "e3", "FILLED", 9), (2, 0, "x", "FILLED", 1)]
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, feed.order_states(whole).collect()))
    assert want == [(1, "FILLED", 9, 1, 1, True), (2, "NEW", 0, 0, 1, False)]
    whole.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, _run(feed.order_states_stream(stream), str(tmp_path), "update"))) == want


def test_feature_stream_equals_batch(spark, tmp_path):
    import time

    from tickforge.operators import features as X
    from tickforge.streaming import features as SF

    rng = np.random.default_rng(3)
    rows = [(DAY * t, f"S{k}", *(float(p * m) for p in [10 + rng.random()] for m in (1.0, 1.02, 0.98, 1.01)), int(rng.integers(1, 99))) for t in range(1, 71) for k in range(3)]
    for i, part in enumerate((rows[:90], rows[90:180], rows[180:])):
        spark.createDataFrame(part, files.BARS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)
    stream = spark.readStream.schema(files.BARS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {(r.timestamp, r.symbol): r for r in _run(SF.feature_stream(stream), str(tmp_path), "append")}
    want = X.bar_v1(spark.createDataFrame(rows, files.BARS)).collect()
    assert len(got) == len(want) == 210
    for w in want:
        g = got[w.timestamp, w.symbol]
        for f in SF.NUMBERS:
            value = g[f]
            assert (0.0 if value is None or np.isnan(value) else value) == pytest.approx(w[f], abs=1e-9), f
    ranked = SF.with_rank(spark.createDataFrame(list(got.values()))).filter("log_return_1 is not null").collect()
    ranks = {(w.timestamp, w.symbol): w.cross_section_return_rank for w in want}
    assert ranked and all(r.cross_section_return_rank == pytest.approx(ranks[r.timestamp, r.symbol]) for r in ranked)
    with pytest.raises(ValueError):
        SF.History(5).push(5, 1, 1, 1, 1, 1)


def test_audit_finds_each_leak(spark):
    import hashlib

    sound = [(t, s, 10 * t + 5, 10 * t + 5, 10 * t + 11, 10 * t + 12, 0, 10 * t) for t in range(10) for s in "ab"]
    schema = "timestamp long, symbol string, " + ", ".join(f"{c} long" for c in U.PROVENANCE[:4]) + ", universe_asof long, reference_data_known_at_max long"
    spec = "{}"
    meta = {k: "x" for k in U.LINEAGE} | {"label_spec_json": spec, "label_spec_sha256": hashlib.sha256(spec.encode()).hexdigest(), "point_in_time_required": True, "prefix_invariance_pass": True, "future_mutation_pass": True}
    parts = [(t, "train" if t < 4 else "validation" if t < 7 else "test") for t in range(10) if t not in (4, 7)]

    def failed(rows=sound, columns=None, split=parts, fit_end=35, **changes):
        df = spark.createDataFrame(rows, schema)
        out = U.audit(df.select(columns) if columns else df, meta | changes, spark.createDataFrame(split, "timestamp long, part string"), fit_end).collect()
        assert all((r.n_bad == 0) == r.passed == (not r.first) and len(r.first) == min(r.n_bad, U.FIRST) for r in out)
        failed.names = {r.check for r in out}
        return {r.check: r.n_bad for r in out if not r.passed}

    def row(i, value, n=7):
        return [*sound[:n], tuple(value if k == i else v for k, v in enumerate(sound[n])), *sound[n + 1 :]]

    assert failed() == {} and len(failed.names) == 17
    assert failed(rows=row(2, 1)) == {"FEATURE_TIME": 1, "REFERENCE_TIME": 1}
    assert failed(rows=row(3, 36)) == {"FEATURE_TIME": 1} and failed(rows=row(7, 36)) == {"REFERENCE_TIME": 1} and failed(rows=row(6, 36)) == {"UNIVERSE_TIME": 1}
    assert failed(rows=row(4, 35)) == {"LABEL_INTERVAL": 1} and failed(rows=row(3, None)) == {"PROVENANCE_LENGTH": 1}
    assert failed(rows=row(5, 55)) == {"TRAIN_VALIDATION_PURGE": 1} and failed(rows=[*sound, sound[0]]) == {"SPLIT_KEY_UNIQUENESS": 2}
    assert failed(split=[*parts, (4, "train")]) == {} and failed(rows=row(5, 85, 13)) == {"VALIDATION_TEST_PURGE": 1}
    assert failed(split=[*parts, (5, "train")])["SPLIT_INDEX_DISJOINT"] == 2 and failed(fit_end=36) == {"NORMALIZER_FIT_SCOPE": 1}
    assert failed(columns=["timestamp", "symbol", "signal_asof"]) == {"PROVENANCE_REQUIRED": 5}
    for change, check in (({"label_spec_sha256": "y"}, "LABEL_SPEC_HASH"), ({"calendar_id": " "}, "LINEAGE_REQUIRED"), ({"dataset_fingerprint": "y"}, "DATASET_FINGERPRINT"), ({"point_in_time_required": False}, "POINT_IN_TIME_DECLARATION"), ({"future_mutation_pass": False}, "FUTURE_MUTATION_PASS"), ({"prefix_invariance_pass": None}, "PREFIX_INVARIANCE_PASS")):
        assert failed(**change) == {check: 1}


def test_joint_drift_tells_samples_apart():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(100, 3)), rng.normal(size=(100, 3))
    same, moved, wide = (dict(K.joint_drift(a, x)) for x in (a, b + 3, b @ np.array([[1, 1, 0], [0, 1, 0], [0, 0, 5]])))
    assert same["correlation_distance"] == same["eigenvalue_distance"] == 0 and same["reference_rank"] == same["current_rank"]
    assert moved["auc"] > 0.95 and moved["mmd_rbf"] > 0.1 and moved["correlation_distance"] < 0.3
    assert wide["correlation_distance"] > 0.4 and wide["eigenvalue_distance"] > 15 and wide["current_rank"] < wide["reference_rank"]


@pytest.mark.parametrize("n", [2, 3, 7, 60, 1300])
def test_mmd_takes_all_rows(monkeypatch, n):
    monkeypatch.setattr(K, "BLOCK", 7 if n < 100 else 500)
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, 4)), rng.normal(0.3, 1, size=(n + 1, 4))
    b[: n // 3] = a[0]  # equal rows
    assert K.mmd_whole(a, b) == pytest.approx(K.mmd(a, b), abs=1e-10)
    z, w = np.unique(np.vstack((a, b)), axis=0, return_counts=True)
    d = ((np.repeat(z, w, axis=0)[:, None] - np.repeat(z, w, axis=0)[None]) ** 2).sum(-1)
    assert K.median_distance(z, w.astype(float), bins=16, most=8) == pytest.approx(np.median(d[d > 0]), rel=1e-9)


def test_drift_embedding_counts_vectors_beyond_512(spark, tmp_path):
    from tickforge import registry

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 3)) + np.arange(2600)[:, None] / 2000
    spark.createDataFrame([(i, [float(k) for k in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.panel, r.name): r.value for r in registry.queries()["drift_embedding"](spark, str(tmp_path)).collect()}
    for panel in (0, 1):
        y = x[panel::2].astype(np.float32).astype(float)
        assert found[panel, "mmd"] == pytest.approx(K.mmd(y[:650], y[650:]), abs=2e-6)


def test_queries_read_whole_tables(spark, tiny):
    from tickforge import registry
    from tickforge.sources.tables import fills, monthly_bars

    q = {k: lambda k=k: registry.queries()[k](spark, tiny) for k in registry.queries()}
    n_fills, bars = fills(spark, tiny).count(), monthly_bars(spark, tiny).cache()
    symbols, n_bars, n_times = bars.select("symbol").distinct().count(), bars.count(), bars.select("timestamp").distinct().count()
    assert q["src_wire_decoder"]().agg(F.sum("n"), F.count_distinct("symbol")).first()[:] == (n_fills, symbols)
    assert {r.kind: r.n for r in q["bt_runner"]().collect()}["equity"] == n_times
    limits = q["bt_limit_order"]().join(bars.select("timestamp", "symbol", "open", "low"), ["timestamp", "symbol"])
    assert limits.select("symbol").distinct().count() > symbols / 2 and limits.filter("price > open + 1e-6 or price < low - 1e-6").count() == 0
    reserve = q["bt_cash_reserve"]()
    assert reserve.agg(F.sum("n")).first()[0] == n_bars and {r.status for r in reserve.select("status").distinct().collect()} == {"EXPIRED", "REJECTED"}
    assert q["bt_sell_reserve"]().agg(F.sum("n")).first()[0] == n_bars
    actions = q["bt_corporate_action"]()
    assert actions.count() == symbols and actions.filter("gain is null").count() == 0
    orders = q["order_planner_sort"]()
    assert q["bt_decision_log"]().count() == orders.count() and orders.select("timestamp").distinct().count() > 1


def test_run_groups_applies_corporate_actions(spark):
    rows = [("r", t, "A", p, p, p, p, 1000, m, 0.1) for t, p, m in ((1, 10.0, None), (2, 10.0, None), (3, 5.0, 2.0))]
    bars = spark.createDataFrame(rows, "run string, timestamp long, symbol string, open double, high double, low double, close double, volume long, share_multiplier double, cash_dividend_per_share double")
    wish = lambda ts, *_: [{"symbol": "A", "side": "BUY", "quantity": 100}] if ts == 1 else []
    out = B.run_groups(bars, lambda _: wish, B.Rules(cash=10_000, participation=1, slippage_bps=0, fee_rate=0)).filter("kind = 'equity'").orderBy("timestamp").collect()
    assert [r.value for r in out] == [10_000, 10_000, 10_000 - 1000 + 10 + 200 * 5]


def test_log_recovers_what_a_crash_leaves():
    from tickforge.streaming import log

    payloads = [b"one", b"", b"three" * 100]
    data = log.frames(payloads)
    assert log.recover(data) == (payloads, 0) and log.recover(b"") == ([], 0)
    for cut in range(1, len(data) + 1):
        found, lost = log.recover(data[:-cut])
        assert found == payloads[: len(found)] and len(log.frames(found)) + lost == len(data) - cut
    broken = bytearray(data)
    broken[12] ^= 1
    with pytest.raises(ValueError):
        log.recover(bytes(broken))
    broken = bytearray(data)
    broken[-1] ^= 1
    assert log.recover(bytes(broken))[0] == payloads[:2]


def test_window_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, float(t * k)) for k, s in enumerate("ab", 1) for t in range(10)], "symbol string, timestamp long, x double")
    for k in range(3):
        rows.filter(F.col("timestamp").between(4 * k, 4 * k + 3)).coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, _run(feed.feature_windows_stream(stream, 3), str(tmp_path), "append")))
    assert got == sorted(map(tuple, feed.feature_windows(rows, 3).collect())) and len(got) == 20


def test_terminal_orders_leave_the_state_store(spark, tmp_path):
    schema = "order_id long, position long, exec_id string, status string, cumulative long"
    rows = [(k, p, f"e{p}", status, 10 * p) for k in range(20) for p, status in enumerate(["ACCEPTED", "FILLED" if k % 4 else "PARTIAL"])]
    for i, part in enumerate((rows, [(100, 0, "e0", "ACCEPTED", 0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = feed.order_states_stream(stream, 1)
    query = out.writeStream.format("memory").queryName("terminal_orders").option("checkpointLocation", f"{tmp_path}/ck").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    held = [x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"]]
    assert held[0] == 20 and held[-1] == 6  # five open orders and the new one


def test_reorder_of_several_feeds_in_one_partition(spark):
    rows = [(f, s, a) for f in ("x", "y") for s, a in ((1, 1), (3, 2), (2, 3), (2, 4), (5, 5), (4, 6))]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = sorted(map(tuple, feed.reorder(spark.createDataFrame(rows, "feed string, sequence long, arrival long")).select("feed", "sequence", "position").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == [(f, k + 1, k) for f in ("x", "y") for k in range(5)]


def test_caches_release_what_is_beyond_their_bound(spark):
    from tickforge.sources.cache import FrameCache

    cache = FrameCache(2000)
    frames = [cache.get(k, lambda: spark.range(100)) for k in (1, 2, 1, 3, 2)]
    assert (cache.hits, cache.misses, cache.evicted) == (1, 4, 2) and not frames[1].is_cached
    assert not cache.get("big", lambda: spark.range(10**6)).is_cached
    cache.clear()
    assert not any(f.is_cached for f in frames)


def test_contracts(spark):
    from tickforge.operators import checks as C

    assert C.risk_model_status(["a", "b"], np.array([[1.0, 2.0], [2.0, 1.0]]), 1, 1) == "NOT_POSITIVE"
    assert C.risk_model_status([], np.zeros((0, 0)), 1, 1) == "BAD_SHAPE" and C.risk_model_status(["a"], np.eye(1), 1, 1) == "OK"
    rows = spark.createDataFrame([(252.0, 0.02, 0.05, 1e6), (None, 0.0, 0.05, 1.0), (1.0, float("nan"), 0.05, 1.0), (1.0, 0.0, 1.0, 1.0), (1.0, 0.0, 0.5, 0.0)], "periods_per_year double, risk_free double, tail double, initial double")
    assert [r[0] for r in rows.select(C.performance_spec_status()).collect()] == ["OK", "BAD_PERIODS", "OK", "BAD_TAIL", "BAD_CAPITAL"]
    loss, sample, prial = K.oracle_loss(np.eye(2) * 1.1, np.eye(2) * 1.2, np.eye(2))
    assert (loss, sample, prial) == pytest.approx((0.02, 0.08, 75.0))


def test_predictions_and_enriched_datasets_refuse_what_is_wrong(spark, tmp_path):
    from tickforge.sources import datasets

    for name, rows in {"twice": [(1, "a", 0.5), (1, "a", 0.6)], "nan": [(1, "a", float("nan"))], "null": [(1, "a", None)]}.items():
        spark.createDataFrame(rows, "timestamp long, symbol string, score double").write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            datasets.predictions(spark, f"{tmp_path}/{name}")


def test_enriched_dataset_is_a_file_a_symbol_and_year(spark, tmp_path):
    import os

    from tickforge.sources import datasets

    day = 86_400_000_000_000
    symbols = [None, "", "a b", "a/=%", *(f"{k:04d}" for k in range(100))]
    rows = [(t * 366 * day + d, s, float(k + t + d)) for k, s in enumerate(symbols) for t in (1, 2, 5) for d in (7, 3)] + [(None, "0007", 1.5)]
    nation = {s: k for k, s in enumerate(symbols) if s and k % 3}
    bars = spark.createDataFrame(rows, "timestamp long, symbol string, close double").repartition(3)
    reference = spark.createDataFrame(list(nation.items()), "symbol string, nation int")
    report = datasets.write_enriched(bars, reference, f"file://{tmp_path}/set")
    wanted, expected = {}, []
    for s in set(symbols):  # a folder's name cannot tell an empty symbol from none
        before = None
        for t, x, c in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0])):
            wanted.setdefault((s or None, None if t is None else 1970 + t // (365 * day)), []).append(t)
            expected.append((t, s or None, c, before, nation.get(s)))
            before = c
    assert {(r.symbol, r.year): (r.n, r.first, r.last, r.unknown) for r in report.collect()} == {
        (s, y): (len(ts), None if y is None else min(ts), None if y is None else max(ts), 0 if s in nation else len(ts)) for (s, y), ts in wanted.items()
    }
    root = f"{tmp_path}/set/rows"
    kept = spark.read.schema("timestamp long, close double, previous_close double, nation int, symbol string, year int").parquet(root)
    assert sorted((tuple(r) for r in kept.select("timestamp", "symbol", "close", "previous_close", "nation").collect()), key=repr) == sorted(expected, key=repr)
    # Spark's own writer starts chmod for each file of a local folder and for its checksum
    assert [names for _, folders, names in os.walk(root) if not folders] == [["part.parquet"]] * len(wanted)
    assert sorted(os.listdir(f"{tmp_path}/set")) == ["report", "rows"]
    empty = datasets.write_enriched(bars.limit(0), reference, f"file://{tmp_path}/empty")
    assert empty.collect() == [] and os.listdir(f"{tmp_path}/empty/rows") == []


def test_dependent_tests_count_beyond_a_thousand(spark):
    from tickforge.operators import drift as D

    n = 1500
    p = np.random.default_rng(2).permutation(np.arange(1, n + 1)) ** 3 / n**3 / 20
    rows = D.adjusted(spark.createDataFrame([(f"{k:04d}", float(x)) for k, x in enumerate(p)], "id string, p double"), dependent=True).collect()
    ordered = np.sort(p)
    q = np.minimum(np.minimum.accumulate((ordered * n * np.sum(1 / np.arange(1, n + 1)) / np.arange(1, n + 1))[::-1])[::-1], 1)
    assert [r.q for r in sorted(rows, key=lambda r: r.p)] == pytest.approx(list(q), rel=1e-12)


def test_gate_candidate(spark):
    from tickforge.operators import models as Y

    def decide(lift, stressed):
        rows = [(t, 0.1 + lift + 0.01 * (t % 3), 0.1 + 0.01 * (t % 3), stressed) for t in range(60)]
        return Y.gate_candidate(spark.createDataFrame(rows, "timestamp long, candidate double, baseline double, stressed double"), draws=99).first().decision

    assert decide(0.05, 0.12) == "PASS" and decide(-0.05, 0.05) == "INFERIOR" and decide(0.05, 0.0) == "FRAGILE"


def test_running_sums_and_previous_rows_over_ranges(spark):
    from tickforge.operators import ranges

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)), int(k), int(rng.integers(0, 9))) for k in range(300)]
    frame = spark.createDataFrame(rows, "x long, k long, n long").repartition(5)
    got = sorted((r.x, r.k, r.n_upto) for r in ranges.running_sums(frame, ["x", "k"], "n").collect())
    ordered = sorted(rows)
    assert got == [(x, k, int(u)) for (x, k, _), u in zip(ordered, np.cumsum([n for *_, n in ordered]))]
    before = {r.k: r.before for r in ranges.with_previous(frame, "k", "x", "before").collect()}
    assert before == {k: None if k == 0 else rows[k - 1][0] for k in range(300)}
    assert ranges.running_sums(frame.limit(0), ["x"], "n").collect() == []


def _cross_sections(spark):
    """Three timestamps: many rows with equal scores, two rows of one relevance, and three rows without gains."""
    rng = np.random.default_rng(11)
    rows = [(1, f"{k:03d}", float(rng.integers(-9, 9)) / 4, float(rng.integers(-20, 20)) / 8, int(rng.integers(0, 5))) for k in range(60)]
    rows += [(2, "a", 0.5, 0.1, 3), (2, "b", 0.25, 0.2, 3), (3, "a", 0.1, 0.5, 0), (3, "b", 0.2, 0.5, -1), (3, "c", 0.3, 0.5, -1)]
    return rows, spark.createDataFrame(rows, "timestamp long, symbol string, score double, label double, relevance int").repartition(3)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString().lower()


def test_list_mle_adds_up_each_row_once(spark):
    rows, frame = _cross_sections(spark)
    losses = []
    for t in (1, 2, 3):
        s = np.array([r[2] for r in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[1]))])
        losses.append(sum(np.log(np.exp(s[i:]).sum()) - s[i] for i in range(len(s))))
    out = M.list_mle(frame)
    assert out.first()[0] == pytest.approx(np.mean(losses), rel=1e-12)
    assert "currentrow$(), unboundedfollowing$()" not in _plan(out)  # such a frame is added up anew for every row


def test_lambda_loss_pairs_rows_with_the_best_only(spark):
    rows, frame = _cross_sections(spark)
    k, losses = 5, []
    for t in (1, 3):  # the relevances of the second timestamp do not differ
        x = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[1]))
        gain, ideal = [2.0 ** r[4] - 1 for r in x], sorted((2.0 ** r[4] - 1 for r in x), reverse=True)
        discount = [1 / np.log2(i + 2) if i < k else 0.0 for i in range(len(x))]
        best = sum(g / np.log2(i + 2) for i, g in enumerate(ideal[:k]))
        pairs = [(abs((gain[i] - gain[j]) * (discount[i] - discount[j])), np.logaddexp(0, x[j][2] - x[i][2])) for i in range(len(x)) for j in range(len(x)) if x[i][4] > x[j][4]]
        total = sum(w for w, _ in pairs)
        losses.append(sum(w * l for w, l in pairs) / total if total and best else 0.0)
    out = M.lambda_loss(frame, k)
    assert out.first()[0] == pytest.approx(np.mean(losses), rel=1e-12)
    assert "join" not in _plan(out)  # of all pairs of a cross-section
