"""Joins in time that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, on: str = "timestamp", right_on: str | None = None, by: str = "symbol", values: list[str] | None = None) -> DataFrame:
    """``left`` with the last ``right`` row of the same ``by`` at or before its time.

    Both sides are merged into one stream and the last right row is carried
    forward: one shuffle and one sort, whatever the number of matches.  Of right
    rows at one instant the largest (by value) wins.  Nulls where nothing is known.
    """
    right_on = right_on or on
    values = values or [c for c in right.columns if c not in (by, right_on)]
    payload = F.struct(F.col(right_on).alias("_at"), *values)
    a = left.withColumns({"_row": F.struct(*left.columns), "_right": F.lit(None), "_side": F.lit(1)}).select(F.col(by).alias("_by"), F.col(on).alias("_t"), "_side", "_row", "_right")
    b = right.select(F.col(by).alias("_by"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), payload.alias("_right"))
    kinds = {"_row": a.schema["_row"].dataType, "_right": b.schema["_right"].dataType}
    a, b = a.withColumn("_right", F.col("_right").cast(kinds["_right"])), b.withColumn("_row", F.col("_row").cast(kinds["_row"]))
    order = Window.partitionBy("_by").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("_last", F.last("_right", True).over(order)).filter("_side = 1")
    return merged.select("_row.*", F.col("_last._at").alias(f"{right_on}_asof"), *(F.col(f"_last.{c}").alias(c) for c in values))


def keep_last(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("_row")).select("_row.*")


def interval(left: DataFrame, right: DataFrame, by: list[str], at: str = "timestamp", start: str = "effective_from", end: str = "effective_to", how: str = "left") -> DataFrame:
    """``left`` with the ``right`` row whose half-open interval holds its time.  Null ``end``: open."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns))
    on = (F.col(at) >= F.col(f"_r_{start}")) & (F.col(f"_r_{end}").isNull() | (F.col(at) < F.col(f"_r_{end}")))
    for c in by:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    rest = [c for c in right.columns if c not in by]
    return left.join(r, on, how).select(*left.columns, *(F.col(f"_r_{c}").alias(c) for c in rest))


def interval_asof(left: DataFrame, right: DataFrame, by: str, at: str = "timestamp", start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """The same for intervals that do not overlap, as an as-of join on their starts: no join product at any size."""
    out = asof(left, right, at, start, by)
    inside = F.col(end).isNull() | (F.col(at) < F.col(end))
    rest = [c for c in right.columns if c not in (by, start)]
    return out.withColumns({c: F.when(inside & F.col(f"{start}_asof").isNotNull(), F.col(c)) for c in rest}).withColumnRenamed(f"{start}_asof", start)


def overlaps(df: DataFrame, by: list[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Intervals that reach into the next one of their key."""
    following = F.lead(start).over(Window.partitionBy(*by).orderBy(start, F.col(end).asc_nulls_last()))
    return df.withColumn("next_from", following).filter(F.col("next_from").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("next_from"))))


def between_bars(bars: DataFrame, events: DataFrame, at: str = "timestamp", event_at: str = "event_at") -> DataFrame:
    """Events with the first bar at or after them: an event in ``(previous, current]`` belongs to the current bar.

    An as-of join forward in time, by time turned around.
    """
    times = bars.select("symbol", at).distinct()
    turned = times.select("symbol", (-F.col(at)).alias("_t"), F.col(at).alias("bar_at"))
    out = asof(events.withColumn("_t", -F.col(event_at)), turned, "_t", "_t", "symbol", ["bar_at"])
    return out.drop("_t", "_t_asof").filter("bar_at is not null")


def skeleton(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """All (timestamp, symbol) of ``calendar``; missing bars repeat the last close with volume 0."""
    joined = calendar.join(bars, ["timestamp", "symbol"], "left").withColumn("bar_observed", F.col("close").isNotNull())
    carried = F.last("close", True).over(Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
    out = joined.withColumn("_last", carried).filter("_last is not null")
    fill: dict[str, Column] = {c: F.coalesce(c, "_last") for c in ("open", "high", "low", "close")}
    return out.withColumns(fill | {"volume": F.coalesce("volume", F.lit(0).cast("long"))}).drop("_last")


def reconcile(local: DataFrame, remote: DataFrame, key: str = "order_id") -> DataFrame:
    """Full outer comparison of two order books: matched, recovered, or unknown on one side, and where quantities differ."""
    a = local.select(key, F.col("quantity").alias("local_quantity"))
    b = remote.select(key, F.col("quantity").alias("remote_quantity"))
    status = (
        F.when(F.col("remote_quantity").isNull(), "LOCAL_UNKNOWN")
        .when(F.col("local_quantity").isNull(), "REMOTE_UNKNOWN")
        .when(F.col("local_quantity") == F.col("remote_quantity"), "MATCHED")
        .otherwise("RECOVERED")
    )
    return a.join(b, key, "full_outer").withColumn("status", status)


def dense_ids(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct values with numbers from 0 in order."""
    return df.select(column).distinct().withColumn("id", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
