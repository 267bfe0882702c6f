"""Drift between a reference and a current sample, and multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.operators.ranges import running_sums


def psi_terms(p: Column, q: Column) -> Column:
    return (q - p) * F.ln(q / p)


def psi_quantile(reference: DataFrame, current: DataFrame, column: str, deciles: int = 10) -> DataFrame:
    """PSI on the reference's decile bins and one bin each for missing, below and above; 0.5 is added to every count.

    The edges are at most ``deciles + 1`` numbers, computed by one aggregation.
    """
    points = [i / deciles for i in range(deciles + 1)]
    edges = reference.agg(F.percentile(column, F.array(*(F.lit(p) for p in points))).alias("e")).first()["e"]
    low, high, inner = edges[0], edges[-1], sorted(set(edges[1:-1]))
    x = F.col(column)
    place = sum((F.when(x >= e, 1).otherwise(0) for e in inner), F.lit(0))
    bin_ = F.when(x.isNull() | F.isnan(x), -1).when(x < low, -2).when(x > high, -3).otherwise(place)
    n_bins = len(inner) + 4
    sides = reference.select(bin_.alias("bin"), F.lit(0).alias("side")).unionByName(current.select(bin_.alias("bin"), F.lit(1).alias("side")))
    counts = sides.groupBy("bin").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    every = reference.sparkSession.createDataFrame([(i,) for i in [-3, -2, -1, *range(len(inner) + 1)]], "bin int")
    rows = every.join(counts, "bin", "left").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = Window.partitionBy()
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(total) + 0.5 * n_bins)
    return rows.select(psi_terms(share("a"), share("b")).alias("t")).agg(F.sum("t").alias("psi"))


def psi_fixed(reference: DataFrame, current: DataFrame, column: str, edges: list[float], floor: float = 1e-6) -> DataFrame:
    """PSI on given edges; probabilities are floored and scaled to 1 again."""
    x = F.col(column)
    bin_ = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    sides = reference.select(bin_.alias("bin"), F.lit(0).alias("side")).unionByName(current.select(bin_.alias("bin"), F.lit(1).alias("side")))
    counts = sides.groupBy("bin").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    every = reference.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(counts, "bin", "left").na.fill(0, ["a", "b"])
    w = Window.partitionBy()
    rows = rows.select(*(F.greatest(F.col(c) / F.sum(c).over(w), F.lit(floor)).alias(c) for c in "ab"))
    rows = rows.select(*((F.col(c) / F.sum(c).over(w)).alias(c) for c in "ab"))
    return rows.agg(F.sum(psi_terms(F.col("a"), F.col("b"))).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov distance, from counts per distinct value."""
    sides = reference.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sides.filter("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = running_sums(counts, ["x"], "a", "b")
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return rows.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))).alias("ks"))


def categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """PSI, Jensen-Shannon, total variation and the share of new categories; missing is a category; 0.5 is added to counts."""
    level = F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__"))
    sides = reference.select(level.alias("k"), F.lit(0).alias("side")).unionByName(current.select(level.alias("k"), F.lit(1).alias("side")))
    counts = sides.groupBy("k").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    w = Window.partitionBy()
    rows = counts.select("a", "b", *(((F.col(c) + 0.5) / (F.sum(c).over(w) + 0.5 * F.count("*").over(w))).alias(f"p{c}") for c in "ab"))
    m = (F.col("pa") + F.col("pb")) / 2
    js = 0.5 * F.col("pa") * F.ln(F.col("pa") / m) + 0.5 * F.col("pb") * F.ln(F.col("pb") / m)
    return rows.agg(
        F.sum(psi_terms(F.col("pa"), F.col("pb"))).alias("psi"), F.sum(js).alias("js"), (0.5 * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("tv"),
        (F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)) / F.nullif(F.sum("b"), F.lit(0))).alias("new_rate"),
    )


def summary(df: DataFrame, column: str, population: bool = False) -> DataFrame:
    """Count, missing, mean, variance, median, MAD and quantiles (linear interpolation)."""
    x = F.col(column)
    quantiles = F.percentile(x, F.array(*(F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95))))
    first = df.agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), (F.var_pop if population else F.var_samp)(x).alias("variance"), quantiles.alias("q"))
    one = F.broadcast(first)  # one row
    mad = df.crossJoin(one.select(F.col("q")[2].alias("_m"))).agg(F.percentile(F.abs(x - F.col("_m")), 0.5).alias("mad"))
    return first.crossJoin(F.broadcast(mad)).select("n", "missing", "mean", "variance", F.col("q")[2].alias("median"), "mad", *(F.col("q")[i].alias(k) for i, k in ((0, "p05"), (1, "p25"), (3, "p75"), (4, "p95"))))


def adjusted(df: DataFrame, p: str = "p", dependent: bool = False, key: str = "id") -> DataFrame:
    """Step-up q-values: Benjamini-Hochberg, or Benjamini-Yekutieli for dependent tests."""
    n = df.count()
    c = sum(1 / i for i in range(1, n + 1)) if dependent else 1.0
    rank = F.row_number().over(Window.orderBy(p, key))
    rows = df.withColumn("_r", rank).withColumn("_q", F.col(p) * n * c / F.col("_r"))
    back = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q", F.least(F.min("_q").over(back), F.lit(1.0))).drop("_r", "_q")


def storey(df: DataFrame, p: str = "p", lambdas: tuple[float, ...] = (0.5,), largest: bool = False, key: str = "id") -> DataFrame:
    """Share of true nulls from p-values above each lambda (mean or largest), and scaled step-up q-values."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(p) > l).alias(f"l{i}") for i, l in enumerate(lambdas))).first()
    shares = [min(1.0, row[f"l{i}"] / ((1 - l) * row["n"])) for i, l in enumerate(lambdas)]
    pi0 = max(shares) if largest else sum(shares) / len(shares)
    return adjusted(df, p, key=key).withColumn("pi0", F.lit(pi0)).withColumn("q", F.least(F.col("q") * pi0, F.lit(1.0)))


def runs_of(df: DataFrame, flag: Column, order: str, *by: str) -> DataFrame:
    """Adds ``streak``: how many rows in a row the flag has held, 0 where it does not."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_island", F.count_if(~F.col("_f")).over(w))
    inner = Window.partitionBy(*by, "_island").orderBy(order)
    return rows.withColumn("streak", F.count_if(F.col("_f")).over(inner).cast("long")).drop("_f", "_island")


def alerts(df: DataFrame, order: str, persist: int = 2, *by: str) -> DataFrame:
    """INFO, WARN or CRITICAL from the flags hard_failure, marginal, joint and concept.

    A hard failure is critical; (marginal or joint) with concept for ``persist``
    windows in a row is; any signal warns; a window without one starts anew.
    """
    both = (F.col("marginal") | F.col("joint")) & F.col("concept")
    rows = runs_of(df, both, order, *by)
    state = (
        F.when(F.col("hard_failure") | (F.col("streak") >= persist), "CRITICAL")
        .when(F.col("marginal") | F.col("joint") | F.col("concept"), "WARN").otherwise("INFO")
    )
    return rows.withColumn("state", state)


def effective_trials(n: int, mean_correlation: float) -> float:
    return n / (1 + (n - 1) * mean_correlation)


def deflated_sharpe(n: int, mean: float, sd: float, m3: float, m4: float, trials: float) -> tuple[float, float]:
    """Sharpe of one period over the threshold that ``trials`` tries reach by chance: (statistic, one-sided p).

    ``m3`` and ``m4`` are the standardised moments with the sample deviation, divided by n.
    """
    sharpe = mean / sd
    threshold = math.sqrt(2 * math.log(max(trials, 1.0)) / n)
    spread = math.sqrt(max(1e-300, (1 - m3 * sharpe + (m4 - 1) / 4 * sharpe**2) / (n - 1)))
    z = (sharpe - threshold) / spread
    return z, 0.5 * math.erfc(z / math.sqrt(2))
