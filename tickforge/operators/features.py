"""Features of bars: per-symbol ROWS windows and one rank across each timestamp.

A window value exists once the window is full of non-null values.  Two
shuffles: by symbol for all rolling features, by timestamp for the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tickforge.functions.numeric import full, percent_rank_average

# The feature names in their order, and the groups.
FEATURES = (
    "log_return_1", "log_return_5", "log_return_10", "log_return_20", "intraday_range", "close_open_return", "overnight_gap", "log_volume",
    "volume_zscore_20", "volatility_5", "volatility_10", "volatility_20", "volatility_60", "ma_deviation_5", "ma_deviation_10", "ma_deviation_20",
    "price_position_20", "breakout_20", "cross_section_return_rank", "is_suspended", "is_listed", "is_st", "is_tradable",
)
GROUPS = {
    "returns": FEATURES[0:4], "bar_structure": FEATURES[4:7], "volume": FEATURES[7:9], "volatility": FEATURES[9:13],
    "trend_position": FEATURES[13:18], "cross_section": FEATURES[18:19], "trade_state": FEATURES[19:23],
}
FLAGS = GROUPS["trade_state"]


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("timestamp")


def rows(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def difference(x: Column, k: int) -> Column:
    return x - F.lag(x, k).over(by_symbol())


def rolling_std(x: Column, n: int) -> Column:
    """Population standard deviation of a full window."""
    return full(x, rows(n), n, F.stddev_pop(x).over(rows(n)))


def zscore(x: Column, n: int) -> Column:
    std = F.stddev_pop(x).over(rows(n))
    return full(x, rows(n), n, (x - F.avg(x).over(rows(n))) / F.nullif(std, F.lit(0.0)))


def ma_deviation(price: Column, n: int) -> Column:
    return full(price, rows(n), n, F.ln(price) - F.ln(F.avg(price).over(rows(n))))


def price_position(price: Column, n: int) -> Column:
    low, high = F.min(price).over(rows(n)), F.max(price).over(rows(n))
    return full(price, rows(n), n, (price - low) / F.nullif(high - low, F.lit(0.0)))


def breakout(price: Column, n: int) -> Column:
    return full(price, rows(n), n, F.ln(price) - F.ln(F.max(price).over(rows(n))))


def signal_price(name: str, columns: list[str]) -> Column:
    """The adjusted price where it is positive, else the raw one."""
    if f"signal_{name}" not in columns:
        return F.col(name)
    return F.when(F.col(f"signal_{name}") > 0, F.col(f"signal_{name}")).otherwise(F.col(name))


def bar_v1(bars: DataFrame, gap_column: str | None = None) -> DataFrame:
    """``timestamp, symbol``, FEATURES (0 where unknown) and ``valid``.

    With ``gap_column`` (a batch sequence), history starts anew after a symbol
    missed a batch.
    """
    flags = {"is_suspended": False, "is_listed": True, "is_st": False, "is_tradable": True}
    bars = bars.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in bars.columns else F.lit(v) for k, v in flags.items()})
    price = {k: signal_price(k, bars.columns) for k in ("open", "high", "low", "close")}
    base = bars.select("timestamp", "symbol", "volume", *flags, *(v.alias(f"_{k}") for k, v in price.items()), *([F.col(gap_column).alias("_seq")] if gap_column else []))
    if gap_column:
        new = F.when(F.col("_seq") - F.lag("_seq").over(by_symbol()) > 1, 1).otherwise(0)
        base = base.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_symbol())).withColumn("symbol", F.struct("symbol", "_run"))
    base = base.withColumns({"_lc": F.ln("_close"), "_lo": F.ln("_open")})
    base = base.withColumn("log_return_1", difference(F.col("_lc"), 1)).withColumn("log_volume", F.log1p(F.col("volume").cast("double")))
    close, r1 = F.col("_close"), F.col("log_return_1")
    out = base.withColumns(
        {f"log_return_{k}": difference(F.col("_lc"), k) for k in (5, 10, 20)}
        | {"intraday_range": F.ln("_high") - F.ln("_low"), "close_open_return": F.col("_lc") - F.col("_lo"), "overnight_gap": F.col("_lo") - F.lag("_lc").over(by_symbol())}
        | {"volume_zscore_20": zscore(F.col("log_volume"), 20)}
        | {f"volatility_{n}": rolling_std(r1, n) for n in (5, 10, 20, 60)}
        | {f"ma_deviation_{n}": ma_deviation(close, n) for n in (5, 10, 20)}
        | {"price_position_20": price_position(close, 20), "breakout_20": breakout(close, 20)}
    )
    if gap_column:
        out = out.withColumn("symbol", F.col("symbol.symbol"))
    out = out.withColumn("cross_section_return_rank", percent_rank_average(r1, "timestamp"))
    numbers = [c for c in FEATURES if c not in FLAGS]
    finite = F.lit(True)
    for c in numbers:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = (finite & F.col("is_listed") & ~F.col("is_suspended")).cast("byte")
    return out.select("timestamp", "symbol", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers), *(F.col(c).cast("double").alias(c) for c in FLAGS), valid.alias("valid"))


def standardize(df: DataFrame, columns: list[str], train: Column, minimum: float = 1e-6) -> DataFrame:
    """Columns scaled by mean and population deviation of the training rows (deviations below ``minimum`` count as 1)."""
    fit = df.filter(train).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)))
    out = df.crossJoin(F.broadcast(fit))  # one row
    scale = {c: F.when(F.col(f"stddev_pop_{c}") < minimum, 1.0).otherwise(F.col(f"stddev_pop_{c}")) for c in columns}
    return out.withColumns({c: (F.col(c) - F.col(f"avg_{c}")) / scale[c] for c in columns}).select(*df.columns)


def clipped(df: DataFrame, columns: list[str], train: Column, bound: float = 8.0) -> DataFrame:
    """Standardised with ``minimum`` 1e-8 and clipped to ``bound``."""
    return standardize(df, columns, train, 1e-8).withColumns({c: F.greatest(F.least(F.col(c), F.lit(bound)), F.lit(-bound)) for c in columns})


def last_valid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each symbol's columns at its last valid row."""
    row = F.max_by(F.struct("timestamp", *columns), F.when(F.col("valid") == 1, F.col("timestamp")))
    return df.filter("valid = 1").groupBy("symbol").agg(row.alias("r")).select("symbol", "r.*")


def padded_windows(df: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Each row with its last ``length`` rows as an array of arrays, zeros before the first, and a mask."""
    rows_ = F.collect_list(F.array(*columns)).over(rows(length))
    missing = F.lit(length) - F.size("_w")
    zeros = F.array(*(F.lit(0.0) for _ in columns))
    out = df.withColumn("_w", rows_)
    return out.select("timestamp", "symbol", F.concat(F.array_repeat(zeros, missing), "_w").alias("window"), F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size("_w"))).alias("mask"))


def moving_average_cross(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Changes of sign of (short - long average) once both windows are full; the first full row only sets the state."""
    a, b = F.avg("close").over(rows(short)), F.avg("close").over(rows(long))
    above = full(F.col("close"), rows(long), long, a > b)
    out = bars.withColumn("above", above).withColumn("before", F.lag("above").over(by_symbol()))
    return out.filter("before is not null and above <> before").select("timestamp", "symbol", F.when(F.col("above"), "BUY").otherwise("SELL").alias("signal"))


def bollinger(bars: DataFrame, n: int, k: float) -> DataFrame:
    """Bands of k population deviations: below buy, above sell."""
    mean, std = F.avg("close").over(rows(n)), F.stddev_pop("close").over(rows(n))
    out = bars.withColumns({"lower": full(F.col("close"), rows(n), n, mean - k * std), "upper": full(F.col("close"), rows(n), n, mean + k * std)})
    signal = F.when(F.col("close") < F.col("lower"), "BUY").when(F.col("close") > F.col("upper"), "SELL")
    return out.withColumn("signal", signal).filter("signal is not null").select("timestamp", "symbol", "close", "lower", "upper", "signal")
