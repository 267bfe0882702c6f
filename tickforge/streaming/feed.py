"""The feed: wire messages, sequence reordering, order states, atomic cross-sections.

Late data is judged by sequence numbers, not by event time: a reorder window
holds early messages, drops late ones and reports gaps for good.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The wire format, big-endian.
HEADER = struct.Struct(">cIQ")  # kind, sequence, exchange timestamp
QUOTE = struct.Struct(">8sIIII")  # symbol, bid and ask price x 10000, bid and ask size
TRADE = struct.Struct(">8sIIc")  # symbol, price x 10000, size, side
PRICE_SCALE = 10_000
WINDOW = 64

MESSAGE = "kind string, sequence long, timestamp long, symbol string, bid double, ask double, bid_size long, ask_size long, price double, size long, side string"


def encode(rows: Iterable[dict]) -> bytes:
    """Messages as bytes: for fixtures and recordings."""
    out = bytearray()
    for m in rows:
        out += HEADER.pack(m["kind"].encode(), m["sequence"], m["timestamp"])
        symbol = m.get("symbol", "").encode().ljust(8, b"\0")
        if m["kind"] == "Q":
            out += QUOTE.pack(symbol, *(round(m[k] * PRICE_SCALE) for k in ("bid", "ask")), m["bid_size"], m["ask_size"])
        elif m["kind"] == "T":
            out += TRADE.pack(symbol, round(m["price"] * PRICE_SCALE), m["size"], m["side"].encode())
    return bytes(out)


def decode(data: bytes) -> tuple[list[tuple], bytes]:
    """Whole messages of a buffer, and the bytes of an unfinished one."""
    rows, at = [], 0
    while at + HEADER.size <= len(data):
        kind, sequence, ts = HEADER.unpack_from(data, at)
        body = {b"Q": QUOTE, b"T": TRADE, b"H": None}.get(kind, 0)
        if body == 0:
            raise ValueError(f"unknown message kind {kind!r} at byte {at}")
        end = at + HEADER.size + (body.size if body else 0)
        if end > len(data):
            break
        symbol = bid = ask = bid_size = ask_size = price = size = side = None
        if body is QUOTE:
            symbol, bid, ask, bid_size, ask_size = QUOTE.unpack_from(data, at + HEADER.size)
            bid, ask = bid / PRICE_SCALE, ask / PRICE_SCALE
        elif body is TRADE:
            symbol, price, size, side = TRADE.unpack_from(data, at + HEADER.size)
            price, side = price / PRICE_SCALE, side.decode()
        rows.append((kind.decode(), sequence, ts, symbol and symbol.rstrip(b"\0").decode(), bid, ask, bid_size, ask_size, price, size, side))
        at = end
    return rows, data[at:]


def decode_files(recordings: DataFrame) -> DataFrame:
    """Messages of recordings (``binaryFile`` rows), a file a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MESSAGE.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                rows, rest = decode(bytes(content))
                if rest:
                    raise ValueError(f"{len(rest)} bytes of an unfinished message")
                yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("bid_size", "ask_size", "size")})

    return recordings.select("content").mapInPandas(run, MESSAGE)


class Reorder:
    """Sequence window of one feed: in order out; late = dropped, beyond the window = resync and a gap for good."""

    def __init__(self, window: int = WINDOW):
        self.window, self.expected = window, None
        self.held: dict[int, object] = {}
        self.counts = {"late": 0, "duplicate": 0, "gaps": 0, "resync": 0}

    def push(self, sequence: int, item: object) -> list[tuple[int, object]]:
        if self.expected is None:
            self.expected = sequence
        if sequence < self.expected:
            self.counts["late"] += 1
            return []
        if sequence in self.held:
            self.counts["duplicate"] += 1
            return []
        out: list[tuple[int, object]] = []
        if sequence >= self.expected + self.window:
            self.counts["resync"] += 1
            out = sorted(self.held.items())
            self.counts["gaps"] += sequence - self.expected - len(out)
            self.held, self.expected = {}, sequence
        self.held[sequence] = item
        while self.expected in self.held:
            out.append((self.expected, self.held.pop(self.expected)))
            self.expected += 1
        return out


REORDERED = "feed string, sequence long, arrival long, position long, late long, duplicate long, gaps long"


def _fold(name: str, state: Reorder, position: int, rows: Iterable[tuple[int, int]]) -> tuple[list[tuple], int]:
    out = []
    for sequence, arrival in rows:
        for s, a in state.push(sequence, arrival):
            out.append((name, s, a, position, state.counts["late"], state.counts["duplicate"], state.counts["gaps"]))
            position += 1
    return out, position


def reorder(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """Batch twin of the stream: fold each feed's messages in order of arrival.

    A task streams through its sorted feeds and holds one window; a feed is serial by nature.
    """
    names = [c.split()[0] for c in REORDERED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, position = object(), Reorder(window), 0
        for frame in frames:
            rows: list[tuple] = []
            for _, part in frame.groupby(frame["feed"].ne(frame["feed"].shift()).cumsum(), sort=False):
                name = part["feed"].iloc[0]
                if name != now:
                    now, state, position = name, Reorder(window), 0
                found, position = _fold(name, state, position, zip(part["sequence"].tolist(), part["arrival"].tolist(), strict=True))
                rows += found
            yield pd.DataFrame(rows, columns=names)

    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.select("feed", "sequence", "arrival").repartition(n, "feed").sortWithinPartitions("feed", "arrival").mapInPandas(run, REORDERED)


def reorder_stream(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same over a stream: the window, counters and position are state, bounded by the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in REORDERED.split(", ")]
    schema = "expected long, sequences array<long>, arrivals array<long>, position long, late long, duplicate long, gaps long, resync long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, position = Reorder(window), 0
        if state.exists:
            expected, sequences, arrivals, position, *counts = state.get
            now.expected, now.held = expected, dict(zip(sequences, arrivals, strict=True))
            now.counts = dict(zip(("late", "duplicate", "gaps", "resync"), counts, strict=True))
        frame = pd.concat(list(frames)).sort_values("arrival")
        rows, position = _fold(key[0], now, position, zip(frame["sequence"].tolist(), frame["arrival"].tolist(), strict=True))
        state.update((now.expected, list(now.held), list(now.held.values()), position, *(now.counts[k] for k in ("late", "duplicate", "gaps", "resync"))))
        yield pd.DataFrame(rows, columns=names)

    return messages.select("feed", "sequence", "arrival").groupBy("feed").applyInPandasWithState(run, REORDERED, schema, "append", GroupStateTimeout.NoTimeout)


# Order states, and which may follow which.
NEXT = {
    "NEW": {"PENDING", "ACCEPTED", "REJECTED"}, "PENDING": {"ACCEPTED", "REJECTED", "PARTIAL", "FILLED", "CANCELED"},
    "ACCEPTED": {"PARTIAL", "FILLED", "CANCELED", "EXPIRED", "PENDING_CANCEL"}, "PARTIAL": {"PARTIAL", "FILLED", "CANCELED", "EXPIRED", "PENDING_CANCEL"},
    "PENDING_CANCEL": {"CANCELED", "FILLED", "PARTIAL", "ACCEPTED"},
}
TERMINAL = {"FILLED", "CANCELED", "REJECTED", "EXPIRED"}
REMEMBERED = 256


class OrderState:
    """One order's state machine: idempotent by execution id, cumulative fills only grow."""

    def __init__(self, status: str = "NEW", cumulative: int = 0, duplicates: int = 0, invalid: int = 0, seen: Iterable[str] = ()):
        self.status, self.cumulative, self.duplicates, self.invalid = status, cumulative, duplicates, invalid
        self.seen = list(seen)

    def apply(self, exec_id: str, status: str, cumulative: int) -> bool:
        if exec_id in self.seen:
            self.duplicates += 1
            return False
        self.seen = [*self.seen, exec_id][-REMEMBERED:]
        if status not in NEXT.get(self.status, ()) or cumulative < self.cumulative:
            self.invalid += 1
            return False
        self.status, self.cumulative = status, cumulative
        return True


ORDER = "order_id long, status string, cumulative long, duplicates long, invalid long, terminal boolean"


def order_states(reports: DataFrame) -> DataFrame:
    """Final state of each order from its reports (``order_id, position, exec_id, status, cumulative``): log replay."""

    names = [c.split()[0] for c in ORDER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, OrderState()
        for frame in frames:
            done = []
            for order, exec_id, status, cumulative in zip(*(frame[k].tolist() for k in ("order_id", "exec_id", "status", "cumulative")), strict=True):
                if order != now:
                    if now is not None:
                        done.append((now, state.status, state.cumulative, state.duplicates, state.invalid, state.status in TERMINAL))
                    now, state = order, OrderState()
                state.apply(exec_id, status, int(cumulative))
            yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([(now, state.status, state.cumulative, state.duplicates, state.invalid, state.status in TERMINAL)], columns=names)

    # one sorted stream a partition: no group is materialised, and a group costs no call of its own
    n = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reports.repartition(n, "order_id").sortWithinPartitions("order_id", "position").mapInPandas(run, ORDER)


def order_states_stream(reports: DataFrame, keep_ms: int = 600_000) -> DataFrame:
    """The state of every order that a micro-batch touches.

    A terminal order stays in the state store for ``keep_ms`` of arrival time after its last report,
    so that late duplicates are known as such, then leaves it; open orders stay as long as they are open.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = "status string, cumulative long, duplicates long, invalid long, seen array<string>"
    names = [c.split()[0] for c in ORDER.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        if store.hasTimedOut:
            store.remove()
            return
        state, at = OrderState(*store.get) if store.exists else OrderState(), 0
        for r in pd.concat(list(frames)).sort_values("position").itertuples():
            state.apply(r.exec_id, r.status, int(r.cumulative))
            at = max(at, int(r.arrived))
        store.update((state.status, state.cumulative, state.duplicates, state.invalid, state.seen))
        if state.status in TERMINAL:
            store.setTimeoutTimestamp(at + keep_ms)
        yield pd.DataFrame([(key[0], state.status, state.cumulative, state.duplicates, state.invalid, state.status in TERMINAL)], columns=names)

    arrived = reports.withColumn("_at", F.current_timestamp()).withWatermark("_at", "0 seconds").withColumn("arrived", F.unix_millis("_at"))
    return arrived.groupBy("order_id").applyInPandasWithState(run, ORDER, schema, "update", GroupStateTimeout.EventTimeTimeout)


WINDOWS = "symbol string, timestamp long, size int, oldest long, total double"


def feature_windows(rows: DataFrame, length: int) -> DataFrame:
    """After each row of ``symbol, timestamp, x``: how many of the last ``length`` rows the window holds, its oldest timestamp and the sum of x."""
    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(1 - length, 0)
    return rows.select("symbol", "timestamp", F.count("*").over(w).cast("int").alias("size"), F.min("timestamp").over(w).alias("oldest"), F.sum("x").over(w).alias("total"))


def feature_windows_stream(rows: DataFrame, length: int) -> DataFrame:
    """The same over a stream: a ring of ``length`` rows a symbol is the state; a timestamp that does not rise is an error."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        at, x = (list(v) for v in store.get) if store.exists else ([], [])
        out = []
        for r in pd.concat(list(frames)).sort_values("timestamp").itertuples():
            if at and r.timestamp <= at[-1]:
                raise ValueError(f"{key[0]}: {r.timestamp} follows {at[-1]}")
            at, x = [*at, int(r.timestamp)][-length:], [*x, float(r.x)][-length:]
            out.append((key[0], at[-1], len(at), at[0], sum(x)))
        store.update((at, x))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return rows.select("symbol", "timestamp", "x").groupBy("symbol").applyInPandasWithState(run, WINDOWS, "at array<long>, x array<double>", "append", GroupStateTimeout.NoTimeout)


def coalesced(events: DataFrame, kind: str, order: list[str], *by: str) -> DataFrame:
    """Contiguous events of one kind as one batch: ``by, batch, kind, n, first, last`` (first and last of ``order[0]``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")
    rows = events.withColumn("_fresh", fresh).withColumn("batch", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "batch").agg(F.first(kind).alias("kind"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def cross_sections(bars: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Complete cross-sections of a stream: a timestamp comes out once a later one has arrived."""
    at = F.timestamp_micros(F.expr("timestamp div 1000"))
    rows = bars.withColumn("event_time", at).withWatermark("event_time", delay)
    return rows.groupBy("event_time").agg(F.first("timestamp").alias("timestamp"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("symbol", "close"))).alias("rows"))


def sessions(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Tumbling trading days of UTC+8: count, first and last event."""
    return events.groupBy(F.window(ts, "1 day", startTime="16 hours").alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(F.to_date(F.col("w.end")).alias("session"), "n", "first", "last")


def merged_events(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars, corporate actions and session marks in replay order: open, actions, bars, close."""
    day = F.col("timestamp") - F.col("timestamp") % 86_400_000_000_000
    b = bars.select("timestamp", F.lit(2).alias("rank"), F.lit("BAR").alias("kind"), "symbol")
    a = actions.select("timestamp", F.lit(1).alias("rank"), F.lit("ACTION").alias("kind"), "symbol")
    days = bars.groupBy(day.alias("d")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    marks = days.select(F.explode(F.array(F.struct(F.col("lo").alias("timestamp"), F.lit(0).alias("rank"), F.lit("OPEN").alias("kind")), F.struct(F.col("hi").alias("timestamp"), F.lit(3).alias("rank"), F.lit("CLOSE").alias("kind")))).alias("m")).select("m.*", F.lit("").alias("symbol"))
    return b.unionByName(a).unionByName(marks).orderBy("timestamp", "rank", "symbol")
