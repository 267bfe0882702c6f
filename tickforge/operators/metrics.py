"""Quality of predictions and rankings.

All take a DataFrame of ``timestamp, symbol, score, label`` (nulls dropped by
the caller) unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions.numeric import average_rank, log_add_exp
from tickforge.operators.ranges import running_sums


def pearson(x: Column, y: Column) -> Column:
    """Correlation, 0 where a side is constant."""
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(scale <= 1e-15, 0.0).otherwise(F.covar_pop(x, y) / scale)


def auc(df: DataFrame, probability: str = "p", label: str = "y") -> DataFrame:
    """Rank-sum AUC with average ties, 0.5 if a class is missing."""
    ranked = df.withColumn("_r", average_rank(F.col(probability)))
    pos, n = F.sum(label), F.count("*")
    value = (F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))
    return ranked.agg(F.coalesce(value, F.lit(0.5)).alias("auc"))


def auc_by_value(df: DataFrame, probability: str = "p", label: str = "y") -> DataFrame:
    """The same from counts per distinct probability, summed up by ranges of it."""
    by = df.groupBy(probability).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.col("neg_upto") - F.col("neg")
    out = running_sums(by, [probability], "neg").select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won"))
    return out.agg(F.coalesce(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), F.lit(0.5)).alias("auc"))


def ece(df: DataFrame, probability: str = "p", label: str = "y", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    p = F.col(probability)
    by = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(label).alias("y"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def pinball(error: Column, q: float) -> Column:
    """Loss of a quantile forecast; ``error`` = outcome - forecast."""
    return F.avg(F.greatest(q * error, (q - 1) * error))


def brier_and_log_loss(df: DataFrame, probability: str = "p", label: str = "y", eps: float = 1e-7) -> DataFrame:
    p, y = F.col(probability), F.col(label)
    c = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return df.agg(F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(y * F.ln(c) + (1 - y) * F.ln(1 - c))).alias("log_loss"))


def regression(df: DataFrame, score: str = "score", label: str = "label", huber: float = 1.0) -> DataFrame:
    """MAE, RMSE, Huber and the correlation."""
    e = F.abs(F.col(score) - F.col(label))
    loss = F.when(e <= huber, 0.5 * e * e).otherwise(huber * (e - 0.5 * huber))
    return df.agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(loss).alias("huber"), pearson(F.col(score), F.col(label)).alias("ic"))


def by_time(df: DataFrame) -> DataFrame:
    """IC and rank IC of each timestamp with two rows or more."""
    ranked = df.withColumns({"_s": average_rank(F.col("score"), "timestamp"), "_l": average_rank(F.col("label"), "timestamp")})
    out = ranked.groupBy("timestamp").agg(F.count("*").alias("n"), pearson(F.col("score"), F.col("label")).alias("ic"), pearson(F.col("_s"), F.col("_l")).alias("rank_ic"))
    return out.filter("n >= 2")


def rank_ic(df: DataFrame) -> DataFrame:
    by = by_time(df)
    sd = F.stddev_samp("ic")
    return by.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.coalesce(F.avg("ic") / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"), F.count("*").alias("n_times"))


def _discount(position: Column) -> Column:
    return 1 / F.log2(position + 1)


def ndcg_tied(df: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """NDCG at k of each timestamp: gains 2^rel - 1, equal scores share their mean discount."""
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    by_score, by_gain = (Window.partitionBy("timestamp").orderBy(*o) for o in ((F.desc("score"), "symbol"), (F.desc(relevance), "symbol")))
    ideal = F.row_number().over(by_gain)
    out = df.withColumns({"_g": gain, "_p": F.row_number().over(by_score), "_i": ideal})
    out = out.withColumn("_d", F.when(F.col("_p") <= k, _discount(F.col("_p"))).otherwise(0.0))
    out = out.withColumn("_d", F.avg("_d").over(Window.partitionBy("timestamp", "score")))
    best = F.sum(F.when(F.col("_i") <= k, F.col("_g") * _discount(F.col("_i"))))
    return out.groupBy("timestamp").agg(F.coalesce(F.sum(F.col("_g") * F.col("_d")) / F.nullif(best, F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def ndcg_first(df: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """NDCG at k of each timestamp, relevance as gain (below 0 counts as 0), ties by symbol."""
    gain = F.greatest(F.col(relevance), F.lit(0.0))
    out = df.withColumn("_g", gain)
    by_score, by_gain = (Window.partitionBy("timestamp").orderBy(F.desc(c), "symbol") for c in ("score", "_g"))
    out = out.withColumns({"_p": F.row_number().over(by_score), "_i": F.row_number().over(by_gain)})
    got = F.sum(F.when(F.col("_p") <= k, F.col("_g") * _discount(F.col("_p"))))
    best = F.sum(F.when(F.col("_i") <= k, F.col("_g") * _discount(F.col("_i"))))
    return out.groupBy("timestamp").agg(F.coalesce(got / F.nullif(best, F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def top_k(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each timestamp, ties by symbol, with their rank."""
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc(score), "symbol"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_index(df: DataFrame) -> DataFrame:
    """Adds ``t``, the index of the timestamp among the distinct ones."""
    t = df.select("timestamp").distinct().withColumn("t", F.row_number().over(Window.orderBy("timestamp")))
    return df.join(t, "timestamp")


def consecutive_overlap(top: DataFrame, k: int) -> DataFrame:
    """``timestamp, overlap, turnover`` of each top-k set with the one before."""
    a = with_index(top.select("timestamp", "symbol"))
    b = a.select((F.col("t") + 1).alias("t"), "symbol", F.lit(1).alias("_kept"))
    both = a.join(b, ["t", "symbol"], "left").groupBy("timestamp", "t").agg(F.count("_kept").alias("n"))
    return both.filter("t > 1").select("timestamp", (F.col("n") / k).alias("overlap"), (1 - F.col("n") / k).alias("turnover"))


def ranking_oos(df: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """Means over timestamps: NDCG, rank IC, precision at k, top less bottom label, turnover."""
    n = F.count("*").over(Window.partitionBy("timestamp"))
    up, down, best = (F.row_number().over(Window.partitionBy("timestamp").orderBy(*o)) for o in ((F.desc("score"), "symbol"), (F.asc("score"), "symbol"), (F.desc("label"), "symbol")))
    rows = df.withColumns({"_n": n, "_u": up, "_d": down, "_b": best})
    each = rows.groupBy("timestamp").agg(
        (F.count_if((F.col("_u") <= k) & (F.col("_b") <= k)) / F.least(F.lit(k), F.first("_n"))).alias("precision"),
        (F.avg(F.when(F.col("_u") <= k, F.col("label"))) - F.avg(F.when(F.col("_d") <= k, F.col("label")))).alias("spread"),
    )
    joined = each.join(ndcg_tied(df, k, relevance), "timestamp").join(by_time(df).select("timestamp", "rank_ic"), "timestamp", "left")
    turned = consecutive_overlap(top_k(df, k), k).select("timestamp", "turnover")
    return joined.join(turned, "timestamp", "left").agg(*(F.avg(c).alias(c) for c in ("ndcg", "rank_ic", "precision", "spread", "turnover")))


def score_buckets(df: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n, mean_label``: floor(rank * buckets / n) with ranks by (score, symbol) in each timestamp."""
    w = Window.partitionBy("timestamp")
    rank = F.row_number().over(w.orderBy("score", "symbol")) - 1
    bucket = F.floor(rank * buckets / F.count("*").over(w)).cast("int")
    return df.withColumn("bucket", bucket).groupBy("timestamp", "bucket").agg(F.count("*").alias("n"), F.avg("label").alias("label")).groupBy("bucket").agg(F.sum("n").alias("n"), F.avg("label").alias("mean_label"))


def list_mle(df: DataFrame) -> DataFrame:
    """Mean over timestamps of the Plackett-Luce loss in order of the label.

    The sums over a row and those behind it run from the end: a frame that ends
    with the partition would be added up anew for every row.
    """
    w = Window.partitionBy("timestamp").orderBy(F.asc("label"), F.desc("symbol")).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("score").over(Window.partitionBy("timestamp"))
    rows = df.withColumn("_m", top).withColumn("_e", F.exp(F.col("score") - F.col("_m")))
    loss = F.ln(F.sum("_e").over(w)) + F.col("_m") - F.col("score")
    return rows.withColumn("_l", loss).groupBy("timestamp").agg(F.sum("_l").alias("loss")).agg(F.avg("loss").alias("list_mle"))


def lambda_loss(df: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """Mean over timestamps of the pairwise logistic loss, weighted by the change of NDCG at k.

    Pairs live within one timestamp's cross-section.  A pair of which neither is
    among the k best has weight 0, so each row meets those k only.  A timestamp
    counts if two of its relevances differ.
    """
    w = Window.partitionBy("timestamp")
    rows = df.filter("timestamp is not null").withColumns({"_g": F.pow(F.lit(2.0), F.col(relevance)) - 1, "_p": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "_i": F.row_number().over(w.orderBy(F.desc(relevance), "symbol"))})
    rows = rows.withColumn("_d", F.when(F.col("_p") <= k, _discount(F.col("_p"))).otherwise(0.0)).withColumn("_r", F.col(relevance))
    best = F.sum(F.when(F.col("_i") <= k, F.col("_g") * _discount(F.col("_i"))).otherwise(0.0)).over(w)
    top = F.collect_list(F.when(F.col("_p") <= k, F.struct("_p", "_r", "_g", "_d", "score"))).over(w)
    pairs = rows.withColumns({"_best": best, "_top": top}).select("timestamp", "_p", "_r", "_g", "_d", "score", "_best", F.explode_outer("_top").alias("_t"))
    t = {c: F.col("_t").getField(c) for c in ("_p", "_r", "_g", "_d", "score")}
    differ = (t["_p"] < F.col("_p")) & (t["_r"] != F.col("_r"))  # two of the k best meet once
    weight = F.abs((F.col("_g") - t["_g"]) * (F.col("_d") - t["_d"])) / F.nullif(F.col("_best"), F.lit(0.0))
    ahead = F.when(t["_r"] > F.col("_r"), F.col("score") - t["score"]).otherwise(t["score"] - F.col("score"))
    pairs = pairs.withColumns({"_w": F.when(differ, weight), "_l": F.when(differ, log_add_exp(F.lit(0.0), ahead))})
    each = pairs.groupBy("timestamp").agg((F.sum(F.col("_w") * F.col("_l")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("loss"), (F.min("_r") < F.max("_r")).alias("some")).filter("some")
    return each.agg(F.avg(F.coalesce("loss", F.lit(0.0))).alias("lambda_loss"))
