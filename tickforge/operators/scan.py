"""Scans, projections and checks of bar tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import close_to
from tickforge.operators.ranges import with_previous

BAR_COLUMNS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
KEY = ("timestamp", "symbol")
SHANGHAI_NS = 8 * 3_600_000_000_000
DAY_NS = 86_400_000_000_000


def symbol_set(symbols: str | Iterable[str] | None) -> tuple[str, ...] | None:
    """Sorted distinct trimmed symbols; a string is one symbol."""
    if symbols is None:
        return None
    names = [symbols] if isinstance(symbols, str) else list(symbols)
    if any(not s.strip() for s in names):
        raise ValueError("a symbol is empty")
    return tuple(sorted({s.strip() for s in names}))


def allowed_columns(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The projection, or an error for unknown columns or none."""
    wanted = list(df.columns if columns is None else columns)
    if not wanted:
        raise ValueError("the projection is empty")
    if unknown := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    return wanted


def query(bars: DataFrame, symbols=None, start: int | None = None, end: int | None = None, columns=None, ordered: bool = True) -> DataFrame:
    """Bars of ``symbols`` in the closed range, in (timestamp, symbol) order if ``ordered``.

    Only comparisons with literals: the filters and the projection reach the files.
    """
    wanted = allowed_columns(bars, columns)
    names = symbol_set(symbols)
    if names is not None:
        bars = bars.filter(F.col("symbol").isin(*names)) if names else bars.filter(F.lit(False))
    if start is not None:
        bars = bars.filter(F.col("timestamp") >= start)
    if end is not None:
        bars = bars.filter(F.col("timestamp") <= end)
    return (bars.orderBy(*KEY) if ordered else bars).select(*wanted)


def cross_section(bars: DataFrame, timestamp: int) -> DataFrame:
    return query(bars, start=timestamp, end=timestamp)


def history(bars: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    return query(bars, symbol, start, end)


def latest(bars: DataFrame, symbol: str, at: int) -> DataFrame:
    """The last bar of a symbol at or before an instant."""
    row = F.max_by(F.struct(*bars.columns), "timestamp").alias("row")
    return bars.filter((F.col("symbol") == symbol) & (F.col("timestamp") <= at)).agg(row).filter("row is not null").select("row.*")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns and fill nulls of present ones."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def normalise(bars: DataFrame, buckets: int = 64) -> DataFrame:
    """Typed bars with the partition columns year, month (Asia/Shanghai) and bucket."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    symbol = F.trim(F.col("symbol").cast("string"))
    date = F.date_from_unix_date(F.expr(f"cast((timestamp + {SHANGHAI_NS}L) div {DAY_NS}L as int)"))
    out = bars.select(
        F.col("timestamp").cast("long"), symbol.alias("symbol"), *(F.col(c).cast("double") for c in ("open", "high", "low", "close")), F.col("volume").cast("long")
    )
    return out.withColumns({"year": F.year(date).cast("short"), "month": F.month(date).cast("byte"), "bucket": F.crc32(F.col("symbol").cast("binary")).bitwiseAND(buckets - 1).cast("short")})


def bar_problems() -> dict[str, Column]:
    """Each check of a bar as a condition that is true for bad rows."""
    prices = ("open", "high", "low", "close")
    finite = [F.coalesce(F.col(c), F.lit(float("nan"))) for c in prices]
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    return {
        "null_value": F.greatest(*(F.col(c).isNull() for c in BAR_COLUMNS)),
        "not_finite": F.greatest(*(F.isnan(c) | (F.abs(c) == float("inf")) for c in finite)),
        "not_positive": F.coalesce(F.least(*prices) <= 0, F.lit(False)),
        "bad_range": F.coalesce((F.col("high") < top) | (F.col("low") > bottom), F.lit(False)),
        "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(False)),
        "bad_timestamp": F.coalesce(F.col("timestamp") <= 0, F.lit(True)),
        "empty_symbol": F.coalesce(F.length(F.trim("symbol")) == 0, F.lit(True)),
    }


def validate(bars: DataFrame) -> DataFrame:
    """One row: rows and the number of bad rows per check, from one pass."""
    return bars.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(k) for k, c in bar_problems().items()))


def execution_problems() -> dict[str, Column]:
    """Checks of limits and lots."""
    return {
        "bad_limits": ~((F.col("lower_limit") > 0) & (F.col("upper_limit") >= F.col("lower_limit"))),
        "bad_lot": ~((F.col("lot_size") > 0) & (F.col("lot_size") == F.floor("lot_size"))),
        "outside_limits": (F.col("close") > F.col("upper_limit")) | (F.col("close") < F.col("lower_limit")),
    }


def signal_problems(factor: str = "factor") -> Column:
    """Whether any signal price is not the raw price times the factor."""
    return F.greatest(*(~close_to(F.col(f"signal_{c}"), F.col(c) * F.col(factor)) for c in ("open", "high", "low", "close")))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*(key or KEY)).agg(F.count("*").alias("n")).filter("n > 1")


def conflicts(staged: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Staged keys that the lake has already."""
    key = key or KEY
    return staged.select(*key).join(existing.select(*key), list(key), "left_semi")


def order_violations(df: DataFrame, position: str, *key: str) -> DataFrame:
    """Rows whose key does not rise strictly in the order of ``position``, a row number of the stream."""
    rows = with_previous(df.withColumn("_now", F.struct(*(key or KEY))), position, "_now", "_before")
    return rows.filter(F.col("_before").isNotNull() & (F.col("_now") <= F.col("_before"))).drop("_now", "_before")


def late_knowledge(df: DataFrame, known_at: str = "known_at", at: str = "timestamp") -> DataFrame:
    """How many rows know something before it was known."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(known_at) > F.col(at)).alias("n_future"))


# The sessions of a trading day.
#: (from, to, session) in minutes after midnight; END-labelled bars close the range.
SESSIONS = ((9 * 60 + 15, 9 * 60 + 25, "OPENING_AUCTION"), (9 * 60 + 30, 11 * 60 + 30, "MORNING"), (13 * 60, 14 * 60 + 57, "AFTERNOON"), (14 * 60 + 57, 15 * 60, "CLOSING_AUCTION"))


def session_of(minute: Column, end_labelled: bool = True, auctions: bool = True) -> Column:
    """Session of a bar by its local minute of day, null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(SESSIONS):
        if auctions or not name.endswith("AUCTION"):
            inside = (minute > lo) & (minute <= hi) if end_labelled else (minute >= lo) & (minute < hi)
            out = F.when(inside, name).otherwise(out)
    return out


def sliced_replay(bars: DataFrame, slices: int) -> DataFrame:
    """Rows in replay order, cut into about equal slices that never part a timestamp: adds ``slice``."""
    by_time = bars.groupBy("timestamp").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    cut = by_time.select("timestamp", F.floor(F.coalesce(before, F.lit(0)) * slices / total).cast("int").alias("slice"))
    return bars.join(cut, "timestamp").repartition("slice").sortWithinPartitions("slice", *KEY)
