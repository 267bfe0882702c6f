"""Features of a stream of bars: the batch definitions, bar by bar, with bounded state per symbol.

State is the last 61 closes and 20 log volumes of a symbol; timestamps of a
symbol must rise.  The cross-section rank needs all symbols of a timestamp, so
it is added to each micro-batch (``with_rank``), whose cross-sections are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tickforge.functions.numeric import percent_rank_average
from tickforge.operators.features import FEATURES, FLAGS

LONGEST = 61
NUMBERS = tuple(f for f in FEATURES if f not in FLAGS and f != "cross_section_return_rank")
SCHEMA = "timestamp long, symbol string, " + ", ".join(f"{f} double" for f in NUMBERS)
_STATE = "last long, closes array<double>, volumes array<double>"


class History:
    """What the features of one symbol need to remember."""

    def __init__(self, last: int | None = None, closes: list[float] = (), volumes: list[float] = ()):
        self.last, self.closes, self.volumes = last, list(closes), list(volumes)

    def push(self, timestamp: int, o: float, high: float, low: float, close: float, volume: float) -> list[float | None]:
        """Features of the next bar, in the order of NUMBERS; None where the window is not full."""
        if self.last is not None and timestamp <= self.last:
            raise ValueError(f"{timestamp} does not follow {self.last}")
        before = self.closes[-1] if self.closes else None
        self.last = timestamp
        self.closes = [*self.closes, close][-LONGEST:]
        self.volumes = [*self.volumes, math.log1p(volume)][-20:]
        c = np.array(self.closes)
        logs = np.log(c)
        steps = np.diff(logs)
        v = np.array(self.volumes)
        out: dict[str, float | None] = {f"log_return_{k}": float(logs[-1] - logs[-1 - k]) if len(c) > k else None for k in (1, 5, 10, 20)}
        out |= {"intraday_range": math.log(high) - math.log(low), "close_open_return": math.log(close) - math.log(o), "overnight_gap": None if before is None else math.log(o) - math.log(before), "log_volume": float(v[-1])}
        std = v.std()
        out["volume_zscore_20"] = float((v[-1] - v.mean()) / std) if len(v) == 20 and std else None
        out |= {f"volatility_{n}": float(steps[-n:].std()) if len(steps) >= n else None for n in (5, 10, 20, 60)}
        out |= {f"ma_deviation_{n}": float(logs[-1] - math.log(c[-n:].mean())) if len(c) >= n else None for n in (5, 10, 20)}
        recent = c[-20:]
        spread = recent.max() - recent.min()
        out["price_position_20"] = float((close - recent.min()) / spread) if len(c) >= 20 and spread else None
        out["breakout_20"] = float(logs[-1] - math.log(recent.max())) if len(c) >= 20 else None
        return [out[f] for f in NUMBERS]


def feature_stream(bars: DataFrame) -> DataFrame:
    """Rolling features of streamed bars (``timestamp, symbol, open, high, low, close, volume``)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = History(*state.get) if state.exists else History()
        rows = []
        for r in pd.concat(list(frames)).sort_values("timestamp").itertuples():
            rows.append((r.timestamp, key[0], *history.push(int(r.timestamp), r.open, r.high, r.low, r.close, float(r.volume))))
        state.update((history.last, [float(x) for x in history.closes], [float(x) for x in history.volumes]))
        yield pd.DataFrame(rows, columns=["timestamp", "symbol", *NUMBERS]).astype({f: "float64" for f in NUMBERS})

    return bars.groupBy("symbol").applyInPandasWithState(run, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def replay(bars: DataFrame) -> DataFrame:
    """The stream's state machine over a whole table: one sorted stream a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, history = None, History()
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if r.symbol != symbol:
                    symbol, history = r.symbol, History()
                rows.append((r.timestamp, symbol, *history.push(int(r.timestamp), r.open, r.high, r.low, r.close, float(r.volume))))
            yield pd.DataFrame(rows, columns=["timestamp", "symbol", *NUMBERS]).astype({f: "float64" for f in NUMBERS})

    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bars.repartition(n, "symbol").sortWithinPartitions("symbol", "timestamp").mapInPandas(run, SCHEMA)


def with_rank(batch: DataFrame) -> DataFrame:
    """A micro-batch of whole cross-sections with the rank of the last return; for ``foreachBatch``."""
    from pyspark.sql import functions as F

    known = F.when(F.isnan("log_return_1"), None).otherwise(F.col("log_return_1"))
    return batch.withColumn("log_return_1", known).withColumn("cross_section_return_rank", percent_rank_average(F.col("log_return_1"), "timestamp"))
