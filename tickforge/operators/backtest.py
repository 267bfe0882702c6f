"""Back-tests: orders, fills, positions and equity.

Shared cash makes a portfolio a serial fold over its bars; independent runs
(models, parameters, symbols) are the unit of parallelism, one group each.
What needs no cash is plain columns and windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_NS = 86_400_000_000_000
UTC8_NS = 8 * 3_600_000_000_000


def commission(notional: Column, is_sell: Column, rate: Column, least: Column, stamp: Column, transfer: Column | None = None) -> Column:
    """max(notional * rate, minimum), transfer fee, and stamp tax on sells."""
    out = F.greatest(notional * rate, least) + F.when(is_sell, notional * stamp).otherwise(0.0)
    return out if transfer is None else out + notional * transfer


def slipped(price: Column, is_buy: Column, basis_points: float) -> Column:
    """Buys pay more, sells get less."""
    return F.when(is_buy, price * (1 + basis_points / 1e4)).otherwise(price * (1 - basis_points / 1e4))


def top_k_targets(frame: DataFrame, k: int, equity: float, weight: float, lot: int = 100, least_score: float = 0.0) -> DataFrame:
    """Long-only targets: the k best scores of each timestamp, equal weight, whole lots; dropped holdings go to 0.

    ``frame``: timestamp, symbol, score, close.
    """
    best = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("score"), "symbol"))
    chosen = frame.filter(F.col("score") >= least_score).withColumn("rank", best).filter(F.col("rank") <= k)
    target = (F.floor(equity * weight / F.col("close") / lot) * lot).cast("long")
    now = chosen.select("timestamp", "symbol", target.alias("target"))
    times = frame.select("timestamp").distinct().withColumn("next", F.lead("timestamp").over(Window.orderBy("timestamp")))
    following = F.lead("timestamp").over(Window.partitionBy("symbol").orderBy("timestamp"))
    dropped = now.withColumn("following", following).join(times, "timestamp").filter("next is not null and (following is null or following <> next)")
    exits = dropped.select(F.col("next").alias("timestamp"), "symbol").join(frame.select("timestamp", "symbol"), ["timestamp", "symbol"], "left_semi")
    return now.unionByName(exits.withColumn("target", F.lit(0).cast("long")))


def targets_to_orders(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """Orders for the difference between targets and projected positions, sells first."""
    delta = F.col("target") - F.coalesce("position", F.lit(0))
    out = targets.join(positions, ["timestamp", "symbol"], "left").withColumn("delta", delta).filter("delta <> 0")
    return out.select("timestamp", "symbol", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("quantity")).orderBy("timestamp", F.desc("side"), "symbol")


def held_before(targets: DataFrame) -> DataFrame:
    """Positions that earlier targets have left: ``timestamp, symbol, position`` of every target."""
    return targets.select("timestamp", "symbol", F.lag("target", 1, 0).over(Window.partitionBy("symbol").orderBy("timestamp")).alias("position"))


def next_open_fills(orders: DataFrame, bars: DataFrame, participation: float = 0.25, basis_points: float = 10.0) -> DataFrame:
    """Unconstrained market orders at the next bar's open, at most ``participation`` of its volume."""
    following = bars.select("symbol", F.col("timestamp").alias("fill_at"), F.lag("timestamp").over(Window.partitionBy("symbol").orderBy("timestamp")).alias("timestamp"), "open", "volume")
    out = orders.join(following, ["timestamp", "symbol"])
    quantity = F.least(F.col("quantity"), F.floor(F.col("volume") * participation).cast("long"))
    return out.withColumn("filled", quantity).filter("filled > 0").select("fill_at", "symbol", "side", F.col("filled").alias("quantity"), slipped(F.col("open"), F.col("side") == "BUY", basis_points).alias("price"))


def equity_metrics(equity: DataFrame, initial: float, *run: str) -> DataFrame:
    """Daily last equity with the initial one before: total and annual return, Sharpe (252, 2 %), maximum drawdown.

    ``equity``: timestamp, equity and the columns of ``run``.
    """
    day = F.floor(F.col("timestamp") / DAY_NS)
    daily = equity.groupBy(*run, day.alias("day")).agg(F.max_by("equity", "timestamp").alias("equity"))
    w = Window.partitionBy(*run).orderBy("day")
    before = F.coalesce(F.lag("equity").over(w), F.lit(initial))
    peak = F.greatest(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(initial))
    rows = daily.withColumns({"r": F.when(before > 0, F.col("equity") / before - 1), "dd": 1 - F.col("equity") / peak})
    days = F.max("day") - F.min("day")
    last = F.max_by("equity", "day")
    sharpe = F.when((F.count("r") >= 2) & (F.stddev_samp("r") > 0), (F.avg("r") - 0.02 / 252) / F.stddev_samp("r") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return rows.groupBy(*run).agg(
        (last / initial - 1).alias("total_return"), F.when(days > 0, F.pow(last / initial, 365.0 / days) - 1).otherwise(0.0).alias("annual_return"),
        sharpe.alias("sharpe"), F.max("dd").alias("max_drawdown"), F.count("*").alias("n_days"),
    )


@dataclass
class Order:
    order_id: int
    symbol: str
    side: str
    quantity: int
    limit: float | None = None
    status: str = "NEW"
    reason: str = ""
    left: int = field(default=0)
    reserve: float = 0.0  # cash that an accepted buy holds back


@dataclass
class Position:
    quantity: int = 0
    cost: float = 0.0
    sellable: int = 0
    realised: float = 0.0
    opened: list = field(default_factory=list)  # open lots: [quantity, price, fee, timestamp]


@dataclass
class Rules:
    """Everything a run fixes beforehand."""

    cash: float = 1_000_000.0
    participation: float = 0.25
    slippage_bps: float = 10.0
    fee_rate: float = 0.0005
    least_fee: float = 0.0
    stamp: float = 0.0
    same_day_sell: bool = True
    allow_short: bool = False
    market_buffer_bps: float = 0.0  # more that a market buy reserves
    fill_timing: str = "OPEN"  # of market orders: the next open, or the close of the bar that brought them


Strategy = Callable[[int, dict[str, dict], dict[str, int], float], list[dict]]


class Engine:
    """One portfolio.  Per timestamp: roll the day, corporate actions, pending orders at the open in order of
    submission, resting limits (best price first, then age), mark at the close, then the strategy.

    An accepted buy reserves its cost and fee, an accepted sell its shares, until it fills or closes; an order
    that asks for more than is free is rejected.  What a fill would cost is checked again at its price: if cash
    no longer covers the rest of the order, it is rejected, or canceled where part of it has been filled.
    """

    def __init__(self, rules: Rules, strategy: Strategy):
        self.rules, self.strategy = rules, strategy
        self.cash = rules.cash
        self.positions: dict[str, Position] = {}
        self.pending: list[Order] = []
        self.resting: list[Order] = []
        self.last: dict[str, float] = {}
        self.reserved = 0.0  # cash of open buys
        self.promised: dict[str, int] = {}  # shares of open sells
        self.used: dict[str, int] = {}  # volume taken from the current bars
        self.day: int | None = None
        self.now: int | None = None
        self.next_id = 1
        self.out: dict[str, list[dict]] = {k: [] for k in ("fill", "order", "equity", "round_trip")}

    def _fee(self, notional: float, sell: bool) -> float:
        return max(notional * self.rules.fee_rate, self.rules.least_fee) + (notional * self.rules.stamp if sell else 0.0)

    def _close(self, order: Order, status: str, reason: str = "") -> None:
        if order.status == "ACCEPTED":
            self._release(order, order.left)
        order.status, order.reason = status, reason
        self.out["order"].append({"timestamp": self.now, "order_id": order.order_id, "symbol": order.symbol, "side": order.side, "quantity": order.quantity, "left": order.left, "status": status, "reason": reason})

    def _release(self, order: Order, n: int) -> None:
        """Give back what ``n`` of an accepted order's open shares hold."""
        if order.side == "SELL":
            self.promised[order.symbol] -= n
        elif order.left:
            part = order.reserve * n / order.left
            order.reserve -= part
            self.reserved -= part

    def _cost(self, n: int, price: float) -> float:
        return n * price + self._fee(n * price, False)

    def _sellable(self, symbol: str) -> int:
        p = self.positions.get(symbol)
        return 0 if p is None else max(0, p.quantity if self.rules.same_day_sell else p.sellable)

    def _fill(self, order: Order, bar: dict, price: float) -> None:
        used = self.used
        n = min(order.left, int(bar["volume"] * self.rules.participation + 1e-9) - used.get(order.symbol, 0))
        if order.side == "SELL" and not self.rules.allow_short:
            n = min(n, self._sellable(order.symbol))
        if n <= 0:
            return
        if order.side == "BUY" and self._cost(order.left, price) > self.cash - self.reserved + order.reserve + 1e-9:
            self._close(order, "REJECTED" if order.left == order.quantity else "CANCELED", "INSUFFICIENT_CASH")
            return
        self._release(order, n)
        used[order.symbol] = used.get(order.symbol, 0) + n
        notional = n * price
        fee = self._fee(notional, order.side == "SELL")
        p = self.positions.setdefault(order.symbol, Position())
        sign = 1 if order.side == "BUY" else -1
        self.cash -= sign * notional + fee
        rest, signed = n, sign
        while rest and p.opened and p.opened[0][0] * signed < 0:
            lot = p.opened[0]
            k = min(rest, abs(lot[0]))
            entry_fee = lot[2] * k / abs(lot[0])
            gross = (price - lot[1]) * k * (1 if lot[0] > 0 else -1)
            self.out["round_trip"].append({"timestamp": self.now, "symbol": order.symbol, "quantity": k, "entry_price": lot[1], "exit_price": price, "opened_at": lot[3], "net_pnl": gross - entry_fee - fee * k / n})
            p.realised += gross
            lot[0] += signed * k
            lot[2] -= entry_fee
            rest -= k
            if lot[0] == 0:
                p.opened.pop(0)
        if rest:
            held = p.quantity if p.quantity * signed > 0 else 0
            p.cost = (p.cost * abs(held) + rest * price) / (abs(held) + rest)
            p.opened.append([signed * rest, price, fee * rest / n, self.now])
        p.quantity += signed * n
        if signed < 0:
            p.sellable = max(0, p.sellable - n)
        order.left -= n
        self.out["fill"].append({"timestamp": self.now, "order_id": order.order_id, "symbol": order.symbol, "side": order.side, "quantity": n, "price": price, "fee": fee})

    def _blocked(self, order: Order, bar: dict) -> bool:
        up, down = bar.get("upper_limit") or 0.0, bar.get("lower_limit") or 0.0
        return bool(bar.get("is_suspended")) or bar["volume"] <= 0 or (order.side == "BUY" and 0 < up <= bar["open"]) or (order.side == "SELL" and 0 < down >= bar["open"])

    def step(self, timestamp: int, bars: dict[str, dict], actions: list[dict] = ()) -> None:
        if self.now is not None and timestamp <= self.now:
            raise ValueError("timestamps must rise")
        self.now = timestamp
        day = (timestamp + UTC8_NS) // DAY_NS
        if day != self.day:
            self.day = day
            for p in self.positions.values():
                p.sellable = p.quantity
        for a in actions:
            self._action(a)
        self.used = {}
        waiting = []
        for order in self.pending:
            bar = bars.get(order.symbol)
            if bar is None or self._blocked(order, bar):
                waiting.append(order)
                continue
            if order.limit is None:
                sign = 1 if order.side == "BUY" else -1
                self._fill(order, bar, bar["open"] * (1 + sign * self.rules.slippage_bps / 1e4))
                if not self._done(order):
                    waiting.append(order)
            else:
                self.resting.append(order)
        self.pending = waiting
        book = sorted(self.resting, key=lambda o: (o.side != "BUY", -o.limit if o.side == "BUY" else o.limit, o.order_id))
        for order in book:
            bar = bars.get(order.symbol)
            if bar is None or self._blocked(order, bar):
                continue
            if order.side == "BUY" and bar["low"] <= order.limit:
                self._fill(order, bar, min(bar["open"], order.limit))
            elif order.side == "SELL" and bar["high"] >= order.limit:
                self._fill(order, bar, max(bar["open"], order.limit))
            self._done(order)
        self.resting = [o for o in self.resting if o.status == "ACCEPTED"]
        for symbol, bar in bars.items():
            self.last[symbol] = bar["close"]
        for wish in self.strategy(timestamp, bars, {s: p.quantity for s, p in self.positions.items()}, self.cash):
            self._submit(wish, bars)
        self.out["equity"].append({"timestamp": timestamp, "cash": self.cash, "equity": self.equity()})

    def _done(self, order: Order) -> bool:
        """Whether an order has closed; one without open shares closes as filled."""
        if order.status == "ACCEPTED" and not order.left:
            self._close(order, "FILLED")
        return order.status != "ACCEPTED"

    def equity(self) -> float:
        return self.cash + sum(p.quantity * self.last.get(s, p.cost) for s, p in self.positions.items())

    def _submit(self, wish: dict, bars: dict[str, dict]) -> None:
        order = Order(self.next_id, wish["symbol"], wish["side"], int(wish["quantity"]), wish.get("limit"), left=int(wish["quantity"]))
        self.next_id += 1
        if order.quantity <= 0 or order.side not in ("BUY", "SELL"):
            self._close(order, "REJECTED", "INVALID_ORDER")
        elif order.limit is not None and not order.limit > 0:
            self._close(order, "REJECTED", "INVALID_LIMIT")
        elif order.symbol not in self.last and order.symbol not in bars:
            self._close(order, "REJECTED", "UNKNOWN_SYMBOL")
        elif order.side == "SELL" and not self.rules.allow_short and self._sellable(order.symbol) - self.promised.get(order.symbol, 0) < order.quantity:
            self._close(order, "REJECTED", "INSUFFICIENT_POSITION")
        elif order.side == "BUY" and self._estimate(order, bars.get(order.symbol)) > self.cash - self.reserved + 1e-9:
            self._close(order, "REJECTED", "INSUFFICIENT_CASH")
        else:
            self._accept(order, bars.get(order.symbol))

    def _estimate(self, order: Order, bar: dict | None) -> float:
        """What a buy may cost: at its limit, or at the last price with slippage and buffer, the upper limit at least."""
        price = order.limit
        if price is None:
            price = self.last.get(order.symbol, 0.0) * (1 + (self.rules.slippage_bps + self.rules.market_buffer_bps) / 1e4)
            price = max(price, (bar or {}).get("upper_limit") or 0.0)
        return self._cost(order.quantity, price)

    def _accept(self, order: Order, bar: dict | None) -> None:
        order.status = "ACCEPTED"
        if order.side == "BUY":
            order.reserve = self._estimate(order, bar)
            self.reserved += order.reserve
        else:
            self.promised[order.symbol] = self.promised.get(order.symbol, 0) + order.left
        if self.rules.fill_timing == "CLOSE" and bar is not None and not self._blocked(order, bar):
            sign = 1 if order.side == "BUY" else -1
            if order.limit is None:
                self._fill(order, bar, bar["close"] * (1 + sign * self.rules.slippage_bps / 1e4))
            elif sign * (order.limit - bar["close"]) >= 0:
                self._fill(order, bar, bar["close"])
        if not self._done(order):
            self.pending.append(order)

    def _action(self, a: dict) -> None:
        symbol = a["symbol"]
        for order in [o for o in self.pending + self.resting if o.symbol == symbol]:
            self._close(order, "CANCELED", "CORPORATE_ACTION")
        self.pending, self.resting = ([o for o in book if o.symbol != symbol] for book in (self.pending, self.resting))
        p = self.positions.get(symbol)
        if p is None or not p.quantity:
            return
        self.cash += p.quantity * a.get("cash_dividend_per_share", 0.0)
        m = a.get("share_multiplier", 1.0)
        if abs(p.quantity * m - round(p.quantity * m)) > 1e-9:
            raise ValueError(f"{symbol}: {p.quantity} shares times {m} are not whole")
        p.quantity, p.sellable, p.cost = round(p.quantity * m), round(p.sellable * m), p.cost / m
        for lot in p.opened:
            lot[0], lot[1] = round(lot[0] * m), lot[1] / m
        if symbol in self.last:
            self.last[symbol] /= m

    def finish(self) -> dict[str, list[dict]]:
        for order in self.pending + self.resting:
            self._close(order, "EXPIRED")
        return self.out


RUN = "run string, kind string, timestamp long, symbol string, side string, order_id long, quantity long, price double, fee double, status string, value double"


def _facts(name: str, out: dict[str, list[dict]]) -> list[tuple]:
    """What an engine has put out so far, as rows of RUN; takes it out of the engine."""
    rows = [(name, "fill", x["timestamp"], x["symbol"], x["side"], x["order_id"], x["quantity"], x["price"], x["fee"], None, None) for x in out["fill"]]
    rows += [(name, "order", x["timestamp"], x["symbol"], x["side"], x["order_id"], x["quantity"], None, None, x["status"], None) for x in out["order"]]
    rows += [(name, "round_trip", x["timestamp"], x["symbol"], None, None, x["quantity"], x["exit_price"], None, None, x["net_pnl"]) for x in out["round_trip"]]
    rows += [(name, "equity", x["timestamp"], None, None, None, None, None, None, None, x["equity"]) for x in out["equity"]]
    for kind in out.values():
        kind.clear()
    return rows


def run_groups(bars: DataFrame, strategy_of: Callable[[str], Strategy], rules: Rules, run: str = "run") -> DataFrame:
    """Fold each run's bars through an engine: fills, closed orders, round trips and equity points as rows of RUN.

    A bar with a ``share_multiplier`` (and ``cash_dividend_per_share``) begins with that corporate action.

    Partitions hold whole runs, sorted; a task streams through them and keeps
    one engine and one cross-section, however many runs and bars there are.
    """
    fields = [c for c in bars.columns if c != run]
    names = [c.split()[0] for c in RUN.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = engine = ts = None
        section: dict[str, dict] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for incoming in batches:
            out: list[tuple] = []
            columns = [incoming[c].to_pylist() for c in fields]
            at = fields.index("timestamp"), fields.index("symbol")
            for key, values in zip(incoming[run].to_pylist(), zip(*columns, strict=True), strict=True):
                if key != name or values[at[0]] != ts:
                    if section:
                        engine.step(ts, section, [b for b in section.values() if b.get("share_multiplier")])
                        section = {}
                    if key != name:
                        if engine is not None:
                            out += _facts(name, engine.finish())
                        name, engine = key, Engine(rules, strategy_of(key))
                    ts = values[at[0]]
                section[values[at[1]]] = dict(zip(fields, values))
            if engine is not None:
                out += _facts(name, engine.out)
            if out:
                yield batch(out)
        if engine is not None:
            if section:
                engine.step(ts, section, [b for b in section.values() if b.get("share_multiplier")])
            if rows := _facts(name, engine.finish()):
                yield batch(rows)

    keyed = bars.withColumn(run, F.col(run).cast("string"))
    # a stated number of partitions: runs cost time, not bytes, so they must not be merged by size
    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, run).sortWithinPartitions(run, "timestamp", "symbol").mapInArrow(fold, RUN)


def cross_strategy(short: int, long: int, lots: int = 100, budget: float | None = None) -> Strategy:
    """Buy when the short average rises over the long one, sell all when it falls below; sums run along.

    A purchase is of ``lots`` shares, or, with a ``budget`` for each symbol, of as many as it pays for.
    """
    seen: dict[str, list] = {}  # closes, short sum, long sum, short above long

    def act(ts: int, bars: dict[str, dict], held: dict[str, int], cash: float) -> list[dict]:
        out = []
        for s in sorted(bars):
            close = bars[s]["close"]
            state = seen.get(s)
            if state is None:
                state = seen[s] = [deque(maxlen=long), 0.0, 0.0, None]
            closes = state[0]
            n = len(closes)
            state[1] += close - (closes[-short] if n >= short else 0.0)
            state[2] += close - (closes[0] if n == long else 0.0)
            closes.append(close)
            if n + 1 < long:
                continue
            above = state[1] * long > state[2] * short
            if above is not state[3]:
                if state[3] is not None:
                    n = lots if budget is None else int(budget / close)
                    if above and n and cash >= close * n:
                        out.append({"symbol": s, "side": "BUY", "quantity": n})
                    elif not above and held.get(s, 0) > 0:
                        out.append({"symbol": s, "side": "SELL", "quantity": held[s]})
                state[3] = above
        return out

    return act
