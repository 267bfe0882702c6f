"""Forward labels and splits on distinct timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import average_rank, sigmoid
from tickforge.operators.features import by_symbol


def next_open(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Entry at the next open, exit at the close ``horizon`` bars later: log return, direction, volatility, validity."""
    entry, exit_ = F.lead("open", 1).over(by_symbol()), F.lead("close", horizon + 1).over(by_symbol())
    out = bars.select("timestamp", "symbol", entry.alias("entry_open"), exit_.alias("exit_close"))
    ok = (F.col("entry_open") > 0) & (F.col("exit_close") > 0)
    r = F.when(ok, F.ln(F.col("exit_close") / F.col("entry_open")))
    return out.withColumn("expected_return", r).withColumns({"direction": (F.col("expected_return") > 0).cast("double"), "volatility": F.abs("expected_return"), "label_valid": F.coalesce(ok, F.lit(False))})


def next_close(bars: DataFrame) -> DataFrame:
    """Simple return to the next close, and when it becomes known."""
    out = bars.select("timestamp", "symbol", (F.lead("close", 1).over(by_symbol()) / F.col("close") - 1).alias("label"), F.lead("timestamp", 1).over(by_symbol()).alias("known_at"))
    return out.filter("label is not null")


def v2(bars: DataFrame, lag: int = 1, horizon: int = 5, threshold: float = 0.0, temperature: float = 0.01, cost: float = 0.001, floor: float = 1e-4, limits: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Soft direction, path volatility, downside deviation, risk-adjusted return, winsorised rank utility and relevance."""
    entry, exit_ = F.lead("open", lag).over(by_symbol()), F.lead("close", lag + horizon).over(by_symbol())
    step = F.ln(F.col("close") / F.lag("close").over(by_symbol()))
    base = bars.withColumn("_step", step).withColumn("_first", F.ln(F.col("close") / F.col("open")))
    path = F.concat(
        F.collect_list("_first").over(by_symbol().rowsBetween(lag, lag)), F.collect_list("_step").over(by_symbol().rowsBetween(lag + 1, lag + horizon))
    )
    out = base.select("timestamp", "symbol", entry.alias("entry_open"), exit_.alias("exit_close"), path.alias("_path"))
    out = out.withColumn("label_valid", F.coalesce((F.col("entry_open") > 0) & (F.col("exit_close") > 0), F.lit(False)))
    raw = F.when(F.col("label_valid"), F.ln(F.col("exit_close") / F.col("entry_open")))
    n = F.lit(float(horizon + 1))
    mean = F.aggregate("_path", F.lit(0.0), lambda a, x: a + x) / n
    out = out.withColumns({"return_raw": raw, "_mean": F.when(F.col("label_valid"), mean)})
    var = F.aggregate("_path", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    down = F.aggregate("_path", F.lit(0.0), lambda a, x: a + F.when(x < 0, x * x).otherwise(0.0)) / n
    valid = F.col("label_valid")
    out = out.withColumns({"expected_return": F.col("return_raw") - cost, "realized_volatility": F.when(valid, F.sqrt(var)), "downside_semivol": F.when(valid, F.sqrt(down))})
    out = out.withColumns({
        "direction_soft": sigmoid((F.col("expected_return") - threshold) / temperature), "direction": (F.col("expected_return") > threshold).cast("double"),
        "risk_adjusted_return": F.col("expected_return") / F.greatest("realized_volatility", F.lit(floor)),
    })
    cuts = out.groupBy("timestamp").agg(F.percentile("risk_adjusted_return", limits[0]).alias("_lo"), F.percentile("risk_adjusted_return", limits[1]).alias("_hi"))
    out = out.join(cuts, "timestamp").withColumn("rank_utility", F.greatest(F.least("risk_adjusted_return", "_hi"), F.col("_lo")))
    count = F.count("rank_utility").over(Window.partitionBy("timestamp"))
    rank = average_rank(F.col("rank_utility"), "timestamp")
    relevance = F.when(F.col("rank_utility").isNotNull(), F.when(count == 1, 0.5).otherwise((rank - 1) / F.nullif(count - 1, F.lit(0))))
    return out.withColumn("rank_relevance", relevance).drop("_path", "_mean", "_lo", "_hi")


def timestamps(df: DataFrame) -> DataFrame:
    """Distinct timestamps with their index from 0: a small table whatever the number of symbols."""
    return df.select("timestamp").distinct().withColumn("i", F.row_number().over(Window.orderBy("timestamp")) - 1)


def chronological(df: DataFrame, train: float = 0.6, validation: float = 0.2, purge: int = 1, embargo: int = 0) -> DataFrame:
    """``timestamp, part``: fractions of the distinct timestamps with gaps of purge + embargo between the parts."""
    t = timestamps(df).withColumn("n", F.count("*").over(Window.partitionBy()))
    a, b, gap = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation)), purge + embargo
    part = (
        F.when(F.col("i") < a, "train").when((F.col("i") >= a + gap) & (F.col("i") < b), "validation").when(F.col("i") >= b + gap, "test")
    )
    return t.withColumn("part", part).filter("part is not null").select("timestamp", "part")


def windows(n: int, train: int, validation: int, test: int, step: int, purge: int, embargo: int, expanding: bool = False, minimum: int = 1) -> list[tuple[int, str, int, int]]:
    """(window, part, first index, index after) of all walk-forward windows over ``n`` timestamps."""
    gap, out, k = purge + embargo, [], 0
    while True:
        first = 0 if expanding else k * step
        end = train + k * step
        v = end + gap
        t = v + validation + gap
        if t + test > n:
            break
        out += [(k, "train", first, end), (k, "validation", v, v + validation), (k, "test", t, t + test)]
        k += 1
    if k < minimum:
        raise ValueError(f"{k} windows fit, {minimum} are asked for")
    return out


def walk_forward(df: DataFrame, train: int = 36, validation: int = 6, test: int = 6, step: int = 6, purge: int = 1, embargo: int = 0, expanding: bool = False) -> DataFrame:
    """``window, part, timestamp``: the windows are few, so a broadcast of their bounds meets the timestamps."""
    spark: SparkSession = df.sparkSession
    t = timestamps(df)
    bounds = windows(t.count(), train, validation, test, step, purge, embargo, expanding)
    table = spark.createDataFrame(bounds, "window int, part string, lo int, hi int")
    return t.join(F.broadcast(table), (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).select("window", "part", "timestamp")


def fixed_oos(df: DataFrame, cutoff: int, length: int) -> DataFrame:
    """Consecutive test windows of ``length`` timestamps after a cutoff; a rest is left out."""
    t = df.select("timestamp").distinct().filter(F.col("timestamp") > cutoff)
    t = t.withColumn("i", F.row_number().over(Window.orderBy("timestamp")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    window = F.floor(F.col("i") / length).cast("int")
    return t.filter(window < F.floor(F.col("n") / length)).select(window.alias("window"), "timestamp")


def ranking_score(r: Column, volatility: Column | None = None, floor: float = 1e-4) -> Column:
    return r if volatility is None else r / F.greatest(volatility, F.lit(floor))
