"""Lakes, files, stores and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.numeric import rounded
from tickforge.operators import scan as S
from tickforge.plans.common import FROM
from tickforge.sources import files, generate
from tickforge.sources.lake import FeatureCache, Lake, ResultStore, scratch
from tickforge.sources.tables import BARS, DAILY, FILLS, daily_bars, fills, monthly_bars, table
from tickforge.streaming import feed

_COLS = "timestamp, symbol, open, high, low, close, volume"


def _lake(s, d):
    lake = Lake(s, scratch(s, "lake"), buckets=1)
    b = monthly_bars(s, d)
    lake.ingest(b.filter(F.col("timestamp") < FROM))
    lake.ingest(b.filter(F.col("timestamp") >= FROM), b.filter(F.col("timestamp") < FROM))  # the second one is known
    return lake


def _csv(s, d):
    path = scratch(s, "csv")
    monthly_bars(s, d).write.option("header", True).csv(path)
    return files.csv_bars(s, path)


def _hive(s, d):
    root = scratch(s, "hive")
    year = F.year(F.timestamp_seconds(F.col("timestamp") / 1000000000))
    daily_bars(s, d).withColumns({"ticker": F.concat(F.lit("t"), "symbol"), "year": year}).write.partitionBy("ticker", "year").parquet(root)
    return files.hive_bars(s, root, [2023, 2024]).select("timestamp", "symbol", "close", F.col("year").cast("int"))


def _reference(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.when(F.col("s_nationkey") % 2 == 0, " Yes").otherwise("0").alias("flag"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")).alias("lot"))
    return files.reference_rows(rows, {"k": "long", "flag": "boolean", "lot": "long"})


def _calendar(s, d):
    rows = table(s, d, "events").select(F.to_date("ts").cast("string").alias("date")).distinct().withColumn("is_open", F.when(F.weekday(F.to_date("date")) < 5, "true").otherwise("n"))
    return files.calendar(rows)


def _cache(s, d):
    cache, b = FeatureCache(s, scratch(s, "features")), monthly_bars(s, d)
    cache.materialise(lambda x: x.select("timestamp", "symbol", rounded(F.ln("close")).alias("x")), b, "source", "logs")
    return cache.materialise(lambda x: x.limit(0), b, "source", "logs")


def _store(s, d):
    store = ResultStore(s, scratch(s, "store"))
    f = fills(s, d).select("order_id", "symbol", "side", "quantity")
    store.persist("a", 1, trades=f)
    store.persist("b", 5, trades=f.filter("side = 'SELL'"))
    return store


def _arrivals(s, d):
    """Events in a shuffled order of arrival, one feed per type; every 50th message is lost, every 31st comes twice."""
    e = table(s, d, "events").select(F.col("event_type").alias("feed"), F.row_number().over(_by_type()).cast("long").alias("sequence"))
    e = e.filter("sequence % 50 <> 0").withColumn("arrival", F.col("sequence") * 10 + F.crc32(F.col("sequence").cast("string")) % 90)
    return e.unionByName(e.filter("sequence % 31 = 0").withColumn("arrival", F.col("arrival") + 1))


def _by_type():
    from pyspark.sql.window import Window

    return Window.partitionBy("event_type").orderBy("event_id")


def _reports(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 3).alias("k"))
    steps = F.array(
        F.struct(F.lit(0).alias("position"), F.lit("e0").alias("exec_id"), F.lit("ACCEPTED").alias("status"), F.lit(0).alias("cumulative")),
        F.struct(F.lit(1).alias("position"), F.lit("e1").alias("exec_id"), F.lit("PARTIAL").alias("status"), F.lit(40).alias("cumulative")),
        F.struct(F.lit(2).alias("position"), F.lit("e1").alias("exec_id"), F.lit("PARTIAL").alias("status"), F.lit(40).alias("cumulative")),
        F.struct(F.lit(3).alias("position"), F.lit("e2").alias("exec_id"), F.when(F.col("k") == 0, "FILLED").when(F.col("k") == 1, "CANCELED").otherwise("PARTIAL").alias("status"), F.when(F.col("k") == 0, 100).otherwise(40).alias("cumulative")),
    )
    return o.select("order_id", F.explode(steps).alias("s")).select("order_id", "s.*")


def _messages(s, d):
    """All fills as trades of the wire format, one feed per symbol in the order of trades: ``symbol, sequence, timestamp, price, size, side``."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("symbol").orderBy("timestamp", "order_id", "l_linenumber", "l_partkey", "quantity", "price", "side")
    return fills(s, d).select("symbol", F.row_number().over(order).cast("long").alias("sequence"), "timestamp", "price", F.col("quantity").alias("size"), F.substring("side", 1, 1).alias("side"))


def _recordings(s, d):
    """The wire bytes of each symbol's messages, at most 10,000 a recording, as rows of ``symbol, part, content``."""

    def run(rows):
        import pandas as pd

        messages = rows.sort_values("sequence").to_dict("records")
        return pd.DataFrame({"symbol": [messages[0]["symbol"]], "part": [messages[0]["part"]], "content": [feed.encode({"kind": "T", **m} for m in messages)]})

    keyed = _messages(s, d).withColumn("part", F.expr("(sequence - 1) div 10000"))
    return keyed.groupBy("symbol", "part").applyInPandas(run, "symbol string, part long, content binary")


def _wire(s, d):
    """Every fill through the wire format and back."""
    return feed.decode_files(_recordings(s, d)).groupBy("kind", "symbol").agg(F.count("*").alias("n"), rounded(F.sum("price"), 4).alias("total"))


QUERIES = {
    "src_csv_bars": (_csv, f"WITH {BARS} SELECT {_COLS} FROM bars"),
    "src_hive_partition_scan": (_hive, f'WITH {DAILY} SELECT timestamp, symbol, close, CAST(2024 AS INTEGER) AS "year" FROM daily'),
    "src_reference_rows": (_reference, "SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS flag, CAST(s_nationkey AS BIGINT) AS lot FROM supplier"),
    "src_calendar_file": (_calendar, "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6"),
    "src_sample_gen": (lambda s, d: generate.sample_daily(s), None),
    "src_wire_decoder": (_wire, f"WITH {FILLS} SELECT 'T' AS kind, symbol, count(*) AS n, floor(sum(round_even(price * 10000, 0) / 10000) * 1e4 + 0.5) / 1e4 AS total FROM fills GROUP BY 1, 2"),
    "snk_ingest_file": (lambda s, d: _lake(s, d).scan(columns=_COLS.split(", ")), f"WITH {BARS} SELECT {_COLS} FROM bars"),
    "snk_partitioned_write": (
        lambda s, d: _lake(s, d).scan().groupBy(F.col("year").cast("int"), F.col("month").cast("int")).agg(F.count("*").alias("n")),
        f'WITH {BARS} SELECT CAST(year(to_timestamp(timestamp / 1000000000 + 28800)) AS INTEGER) AS "year", CAST(month(to_timestamp(timestamp / 1000000000 + 28800)) AS INTEGER) AS "month", count(*) AS n FROM bars GROUP BY 1, 2',
    ),
    "snk_copy_parquet": (lambda s, d: _copied(s, d), f"WITH {BARS} SELECT {_COLS} FROM bars"),
    "meta_snapshot": (lambda s, d: (lambda lake: lake.scan(lake.snapshot(1), columns=["timestamp", "symbol"]))(_lake(s, d)), f"WITH {BARS} SELECT timestamp, symbol FROM bars WHERE timestamp < {FROM}"),
    "snk_catalog_commit": (lambda s, d: s.createDataFrame([(_lake(s, d).summary()["generation"], _lake(s, d).summary()["n_rows"])], "generation long, n_rows long"), f"WITH {BARS} SELECT CAST(2 AS BIGINT) AS generation, count(*) AS n_rows FROM bars"),
    "snk_feature_cache": (_cache, f"WITH {BARS} SELECT timestamp, symbol, floor(ln(close) * 1e6 + 0.5) / 1e6 AS x FROM bars"),
    "snk_result_store": (lambda s, d: _store(s, d).read("trades").groupBy("run_id").agg(F.count("*").alias("n")), f"WITH {FILLS}, f AS (SELECT * FROM fills) SELECT 'a' AS run_id, count(*) AS n FROM f UNION ALL SELECT 'b', count(*) FROM f WHERE side = 'SELL'"),
    "snk_run_lifecycle": (lambda s, d: _store(s, d).runs(), "SELECT * FROM (VALUES ('b', 'SUCCEEDED', CAST(6 AS BIGINT)), ('a', 'SUCCEEDED', CAST(2 AS BIGINT))) t(run_id, status, created_at)"),
    "st_reorder": (lambda s, d: feed.reorder(_arrivals(s, d)).groupBy("feed").agg(F.count("*").alias("n"), F.max("gaps").alias("gaps"), F.max("duplicate").alias("duplicate")), None),
    "st_order_state": (
        lambda s, d: feed.order_states(_reports(s, d)).groupBy("status", "terminal").agg(F.count("*").alias("n"), F.sum("duplicates").alias("duplicates")),
        "SELECT CASE o_custkey % 3 WHEN 0 THEN 'FILLED' WHEN 1 THEN 'CANCELED' ELSE 'PARTIAL' END AS status, o_custkey % 3 < 2 AS terminal, count(*) AS n, count(*) AS duplicates FROM orders GROUP BY 1, 2",
    ),
    "st_tumbling_session": (
        lambda s, d: feed.sessions(table(s, d, "events")).select(F.col("session"), "n"),
        "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS session, count(*) AS n FROM events GROUP BY 1",
    ),
    "st_event_merge": (
        lambda s, d: feed.merged_events(monthly_bars(s, d), fills(s, d).filter("side = 'SELL'").select("timestamp", "symbol")).groupBy("kind").agg(F.count("*").alias("n")),
        f"WITH {BARS}, {FILLS} SELECT 'BAR' AS kind, count(*) AS n FROM bars UNION ALL SELECT 'ACTION', count(*) FROM fills WHERE side = 'SELL' UNION ALL SELECT k, count(DISTINCT timestamp) FROM bars, (VALUES ('OPEN'), ('CLOSE')) v(k) GROUP BY 1",
    ),
    "st_atomic_cross_section": (lambda s, d: feed.cross_sections(monthly_bars(s, d)).select("timestamp", "n"), f"WITH {BARS} SELECT timestamp, count(*) AS n FROM bars GROUP BY 1"),
    "st_latency": (
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(*(F.percentile("value", q).alias(k) for q, k in ((0.5, "p50"), (0.99, "p99")))).select("event_type", rounded(F.col("p50")).alias("p50"), rounded(F.col("p99")).alias("p99")),
        "SELECT event_type, floor(quantile_cont(value, 0.5) * 1e6 + 0.5) / 1e6 AS p50, floor(quantile_cont(value, 0.99) * 1e6 + 0.5) / 1e6 AS p99 FROM events GROUP BY 1",
    ),
}


def _copied(s, d):
    path = scratch(s, "copy")
    S.query(monthly_bars(s, d)).write.parquet(path)
    return files.parquet_bars(s, path)
