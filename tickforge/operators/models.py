"""Baseline models fitted by aggregation, and walk-forward evaluation.

A fit needs sums of products only: one pass of partial aggregates, whatever the
number of rows; the small system is solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _system(df: DataFrame, x: list[str], y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    cols = [F.lit(1.0), *(F.col(c) for c in x)]
    w = F.lit(1.0) if weight is None else weight
    n = len(cols)
    row = df.agg(*(F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(w * c * y).alias(f"b{i}") for i, c in enumerate(cols))).first()
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(n)])


def ridge(df: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> np.ndarray:
    """Intercept (not penalised) and coefficients."""
    a, b = _system(df, x, F.col(y))
    penalty = alpha * np.eye(len(a))
    penalty[0, 0] = 1e-12
    return np.linalg.solve(a + penalty, b)


def linear(w: np.ndarray, x: list[str]) -> Column:
    return sum((F.lit(float(k)) * F.col(c) for k, c in zip(w[1:], x, strict=True)), F.lit(float(w[0])))


def logistic(df: DataFrame, x: list[str], y: str, alpha: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Iteratively reweighted least squares with a ridge; one aggregation a round."""
    w = np.zeros(len(x) + 1)
    penalty = alpha * np.eye(len(w))
    penalty[0, 0] = 1e-12
    for _ in range(rounds):
        p = F.lit(1.0) / (1 + F.exp(-linear(w, x)))
        a, g = _system(df, x, (F.col(y) - p) / (p * (1 - p)), p * (1 - p))
        step = np.linalg.solve(a + penalty, g - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def walk_forward(df: DataFrame, windows: DataFrame, x: list[str], y: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0)) -> list[dict]:
    """Per window: alpha by validation error, ridge on train, test MAE and IC, quantile offsets of the residuals."""
    out = []
    for k in sorted(r["window"] for r in windows.select("window").distinct().collect()):
        parts = {p: df.join(F.broadcast(windows.filter((F.col("window") == k) & (F.col("part") == p)).select("timestamp")), "timestamp", "left_semi") for p in ("train", "validation", "test")}
        fits = [(alpha, ridge(parts["train"], x, y, alpha)) for alpha in alphas]
        errors = parts["validation"].agg(*(F.avg(F.abs(F.col(y) - linear(w, x))).alias(f"e{i}") for i, (_, w) in enumerate(fits))).first()
        best = min(range(len(fits)), key=lambda i: (errors[i], i))
        alpha, w = fits[best]
        e = F.col(y) - linear(w, x)
        low, high = parts["validation"].agg(F.percentile(e, F.array(F.lit(0.1), F.lit(0.9))).alias("q")).first()["q"]
        got = parts["test"].agg(F.avg(F.abs(e)).alias("mae"), F.corr(F.col(y), linear(w, x)).alias("ic"), F.avg(((e >= low) & (e <= high)).cast("double")).alias("coverage"), F.count("*").alias("n")).first()
        out.append({"window": k, "alpha": alpha, "mae": got["mae"], "ic": got["ic"], "coverage": got["coverage"], "n": got["n"]})
    return out


def promotion(metrics: DataFrame, least_ic: float = 0.0, least_wins: float = 0.5) -> DataFrame:
    """Gates over one row a window (candidate, baseline): mean, worst, win share and the verdict."""
    row = metrics.agg(F.avg("candidate").alias("mean"), F.min("candidate").alias("worst"), F.avg((F.col("candidate") > F.col("baseline")).cast("double")).alias("wins"), F.count("*").alias("n"))
    return row.withColumn("verdict", F.when(F.col("mean") <= least_ic, "REJECT_MEAN").when(F.col("wins") < least_wins, "REJECT_WINS").otherwise("PROMOTE"))


def gate_candidate(rows: DataFrame, block: float = 5.0, draws: int = 999, seed: int = 1, margin: float = 0.0, stress_margin: float = 0.5) -> DataFrame:
    """Whether a candidate may replace a baseline: ``mean, lo, hi, stress_share, decision`` of paired metrics.

    ``rows``: timestamp, candidate, baseline, stressed (the candidate under stress), one row a timestamp.
    The stationary bootstrap bounds the mean of the paired deltas; the gate asks that it is not below
    ``-margin`` and that stress takes no more than ``stress_margin`` of the candidate's mean.
    """
    from tickforge.operators import risk

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("timestamp")
        delta = (pdf["candidate"] - pdf["baseline"]).to_numpy()
        mean, _, lo, hi = risk.stationary_bootstrap(delta, block, draws, seed)
        whole = float(np.mean(pdf["candidate"]))
        lost = (whole - float(np.mean(pdf["stressed"]))) / abs(whole) if whole else 0.0
        decision = "INFERIOR" if lo < -margin else "FRAGILE" if lost > stress_margin else "PASS"
        return pd.DataFrame([(float(mean), float(lo), float(hi), lost, decision)], columns=["mean", "lo", "hi", "stress_share", "decision"])

    return rows.groupBy().applyInPandas(run, "mean double, lo double, hi double, stress_share double, decision string")
