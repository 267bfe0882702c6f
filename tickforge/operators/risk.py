"""Dense kernels of portfolio mathematics on collected panels (NumPy), and their grouped use in Spark.

A panel is small (assets x assets); what grows, the number of panels, is the
unit of parallelism: one group each through ``per_group``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_cov(x: np.ndarray) -> np.ndarray:
    """Population covariance of rows x assets."""
    c = x - x.mean(0)
    return c.T @ c / len(x)


def correlation(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd), sd


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrinkage towards constant correlation, and its intensity."""
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    sd = np.sqrt(np.diag(s))
    rho = s / np.outer(sd, sd)
    mean = (rho.sum() - p) / (p * (p - 1)) if p > 1 else 0.0
    target = mean * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    pi = (c**2).T @ (c**2) / n - s**2
    theta = (c**3).T @ c / n - np.diag(s)[:, None] * s
    off = ~np.eye(p, dtype=bool)
    r = np.trace(pi) + mean * ((sd[None, :] / sd[:, None]) * theta)[off].sum()
    gamma = ((s - target) ** 2).sum()
    delta = 1.0 if gamma < 1e-18 else min(1.0, max(0.0, (pi.sum() - r) / gamma / n))
    return delta * target + (1 - delta) * s, delta


def _rescaled(values: np.ndarray, vectors: np.ndarray, sd: np.ndarray) -> np.ndarray:
    m = vectors * values @ vectors.T
    d = np.sqrt(np.diag(m))
    return m / np.outer(d, d) * np.outer(sd, sd)


def denoise(cov: np.ndarray, n: int, alpha: float = 1.0, tolerance: float = 1e-9) -> np.ndarray:
    """Correlation eigenvalues below the Marchenko-Pastur edge move by ``alpha`` towards their mean."""
    corr, sd = correlation(cov)
    values, vectors = np.linalg.eigh(corr)
    noise = values <= (1 + math.sqrt(len(cov) / n)) ** 2 * (1 + tolerance)
    if noise.any():
        values = np.where(noise, (1 - alpha) * values + alpha * values[noise].mean(), values)
    return _rescaled(values, vectors, sd)


def detone(cov: np.ndarray, k: int = 1, floor: float = 1e-12) -> np.ndarray:
    """Correlation without its k largest components, diagonal 1 again."""
    corr, _ = correlation(cov)
    values, vectors = np.linalg.eigh(corr)
    values[len(values) - k :] = 0
    m = vectors * values @ vectors.T
    d = np.diag(m)
    if (d <= floor).any():
        raise ValueError("nothing is left of an asset")
    return m / np.sqrt(np.outer(d, d))


def risk_contributions(weights: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Shares of the variance, summing to 1."""
    m = cov @ weights
    return weights * m / (weights @ m)


def risk_budget(cov: np.ndarray, budget: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Long-only weights whose risk shares are the budget, by cyclic coordinate descent."""
    p = len(cov)
    b = np.full(p, 1 / p) if budget is None else np.asarray(budget, float)
    x = np.sqrt(b / np.diag(cov))
    for _ in range(rounds):
        before = x.copy()
        for i in range(p):
            c = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-c + math.sqrt(c * c + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
        if np.abs(x - before).max() < tolerance:
            break
    return x / x.sum()


def linkage(cov: np.ndarray) -> tuple[list[tuple[int, int, float]], list[int]]:
    """Complete linkage on sqrt((1 - rho) / 2), ties by smallest ids; the merges and the leaves in their order."""
    corr, _ = correlation(cov)
    p = len(corr)
    distance = np.sqrt(np.maximum(0, (1 - corr) / 2))
    members: dict[int, list[int]] = {i: [i] for i in range(p)}
    merges: list[tuple[int, int, float]] = []
    while len(members) > 1:
        ids = sorted(members)
        d, a, b = min((float(distance[np.ix_(members[a], members[b])].max()), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
        merges.append((a, b, d))
        members[p + len(merges) - 1] = members.pop(a) + members.pop(b)
    return merges, next(iter(members.values()))


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: halves of the quasi-diagonal order share by inverse cluster variance."""
    _, order = linkage(cov)
    w = np.ones(len(cov))

    def variance(items: list[int]) -> float:
        sub = cov[np.ix_(items, items)]
        v = 1 / np.diag(sub)
        v /= v.sum()
        return float(v @ sub @ v)

    stack = [order]
    while stack:
        items = stack.pop()
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            a, b = variance(left), variance(right)
            w[left] *= b / (a + b)
            w[right] *= a / (a + b)
            stack += [left, right]
    return w


def simplex(v: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Nearest point with sum 1 and 0 <= w <= cap, by bisection on the shift."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.clip(v - mid, 0, cap).sum() > 1:
            lo = mid
        else:
            hi = mid
    return np.clip(v - (lo + hi) / 2, 0, cap)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Maximise mu'w - aversion/2 w'Cov w on the capped simplex by projected gradient."""
    step = 1 / max(1.0, aversion * float(np.linalg.eigvalsh(cov)[-1]))
    w = simplex(np.full(len(mu), 1 / len(mu)), cap)
    for _ in range(rounds):
        new = simplex(w + step * (mu - aversion * cov @ w), cap)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def min_variance(cov: np.ndarray, cap: float = 1.0, rounds: int = 5000) -> np.ndarray:
    scale = np.abs(cov).sum(1).max()
    return mean_variance(np.zeros(len(cov)), cov / scale, 1.0, cap, rounds)


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette; singletons count 0."""
    out = []
    for i in range(len(label)):
        own = (label == label[i]) & (np.arange(len(label)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = distance[i, own].mean()
        b = min(distance[i, label == k].mean() for k in set(label.tolist()) - {label[i]})
        out.append((b - a) / max(a, b, 1e-300))
    return float(np.mean(out))


def medoids(distance: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-medoid labels: the first medoid by seed, the rest farthest first, then assign and update to the fixpoint."""
    p = len(distance)
    chosen = [seed % p]
    while len(chosen) < k:
        chosen.append(int(np.argmax(np.where(np.isin(np.arange(p), chosen), -1, distance[:, chosen].min(1)))))
    chosen = sorted(chosen)
    for _ in range(100):
        label = np.argmin(distance[:, chosen], axis=1)
        new = sorted(int(np.flatnonzero(label == c)[np.argmin(distance[np.ix_(label == c, label == c)].sum(1))]) for c in range(k) if (label == c).any())
        if new == chosen or len(new) < k:
            break
        chosen = new
    return label


def onc(cov: np.ndarray, most: int = 5, seeds: int = 5, least: int = 1) -> np.ndarray:
    """Clusters with the best mean silhouette over a grid of k and seeds; ties: fewer clusters, then assignment."""
    corr, _ = correlation(cov)
    distance = np.sqrt(np.maximum(0, (1 - corr) / 2))
    best = None
    for k in range(2, min(most, len(cov) - 1) + 1):
        for seed in range(seeds):
            label = medoids(distance, k, seed)
            sizes = np.bincount(label, minlength=k)
            if (sizes < least).any():
                continue
            names = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}
            label = np.array([names[c] for c in label])
            key = (-round(silhouette(distance, label), 12), k, tuple(label.tolist()))
            if best is None or key < best[0]:
                best = key, label
    return np.zeros(len(cov), int) if best is None else best[1]


def nco(cov: np.ndarray, label: np.ndarray, solve: Callable[[np.ndarray], np.ndarray] = min_variance) -> np.ndarray:
    """Optimise inside clusters, then between them."""
    inner = np.zeros((len(cov), int(label.max()) + 1))
    for c in range(inner.shape[1]):
        items = np.flatnonzero(label == c)
        inner[items, c] = solve(cov[np.ix_(items, items)])
    return inner @ solve(inner.T @ cov @ inner)


def black_litterman(mu: np.ndarray, cov: np.ndarray, p: np.ndarray, q: np.ndarray, confidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of linear views; noise = variance (1 - confidence), confidence 0 is no view."""
    keep = confidence > 0
    p, q, confidence = p[keep], q[keep], confidence[keep]
    if not len(q):
        return mu, cov
    var = np.diag(p @ cov @ p.T)
    gain = cov @ p.T @ np.linalg.pinv(p @ cov @ p.T + np.diag(var * (1 - confidence)))
    return mu + gain @ (q - p @ mu), cov - gain @ p @ cov


def entropy_tilt(prior: np.ndarray, f: np.ndarray, target: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probabilities nearest to the prior (relative entropy) with E[f] = target, by damped Newton on the dual."""
    if ((target < f.min(0) - 1e-12) | (target > f.max(0) + 1e-12)).any():
        raise ValueError("a target is outside the support")
    lam = np.zeros(f.shape[1])

    def dual(l: np.ndarray) -> tuple[float, np.ndarray]:
        e = np.log(prior) + f @ l
        top = e.max()
        w = np.exp(e - top)
        return top + math.log(w.sum()) - l @ target, w / w.sum()

    value, p = dual(lam)
    for _ in range(rounds):
        mean = p @ f
        grad = mean - target
        if np.abs(grad).max() < 1e-12:
            break
        step = np.linalg.lstsq((f - mean).T @ ((f - mean) * p[:, None]) + 1e-14 * np.eye(len(lam)), grad, rcond=None)[0]
        size = 1.0
        while size >= 1 / 1024:
            new, q = dual(lam - size * step)
            if new <= value:
                break
            size /= 2
        lam, value, p = lam - size * step, new, q
    return p


def weighted_stats(x: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray | float]:
    """Mean, covariance, effective sample size and divergence from uniform."""
    mu = p @ x
    c = x - mu
    return {"mean": mu, "cov": c.T @ (c * p[:, None]), "ess": float(1 / (p @ p)), "kl": float((p[p > 0] * np.log(p[p > 0] * len(p))).sum())}


def reconcile(current: np.ndarray, target: np.ndarray, penalty: float = 1.0, linear: float = 0.0, impact: float = 0.0, turnover: float = 2.0, cap: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Weights near a target at the cost of trading: proximal gradient with soft thresholds, then turnover shrinks."""
    step = 1 / max(1.0, penalty + impact)
    w = current.copy()
    for _ in range(rounds):
        g = w - step * (penalty * (w - target) + impact * (w - current))
        trade = g - current
        trade = np.sign(trade) * np.maximum(np.abs(trade) - step * linear, 0)
        new = simplex(current + trade, cap)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    moved = np.abs(w - current).sum()
    return current + (w - current) * min(1.0, turnover / moved) if moved > turnover else w


def wls(x: np.ndarray, r: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Factor returns of one date."""
    return np.linalg.lstsq(x * np.sqrt(w)[:, None], r * np.sqrt(w), rcond=None)[0]


def garch(r: np.ndarray, rounds: int = 20) -> tuple[float, float, float]:
    """omega, alpha, beta of GARCH(1,1) by a grid and coordinate search of the Gaussian likelihood; omega fits the variance."""
    x = r - r.mean()
    v0 = float(x.var())

    def loss(a: float, b: float) -> float:
        if a <= 0 or b < 0 or a + b >= 0.999:
            return math.inf
        v, out = v0, 0.0
        for e in x:
            out += math.log(v) + e * e / v
            v = v0 * (1 - a - b) + a * e * e + b * v
        return out

    best = min((loss(a, b), a, b) for a in (0.03, 0.1, 0.2) for b in (0.7, 0.85, 0.95))
    size = 0.05
    for _ in range(rounds):
        near = min((loss(best[1] + i * size, best[2] + j * size), best[1] + i * size, best[2] + j * size) for i in (-1, 0, 1) for j in (-1, 0, 1))
        if near[0] < best[0]:
            best = near
        else:
            size /= 2
    return v0 * (1 - best[1] - best[2]), best[1], best[2]


def filtered_scenarios(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Standardised residuals times the next period's deviation."""
    x = r - r.mean()
    v, out = float(x.var()), []
    for e in x:
        out.append(e / math.sqrt(v))
        v = omega + alpha * e * e + beta * v
    return r.mean() + np.array(out) * math.sqrt(v)


def evt_tail(losses: np.ndarray, level: float = 0.99, threshold: float = 0.9) -> tuple[float, float]:
    """VaR and expected shortfall of a generalised Pareto tail fitted by moments."""
    u = float(np.quantile(losses, threshold))
    over = losses[losses > u] - u
    m, v = over.mean(), over.var()
    xi, scale = 0.5 * (1 - m * m / v), 0.5 * m * (1 + m * m / v)
    q = len(over) / len(losses) / (1 - level)
    var = u + (scale * math.log(q) if abs(xi) < 1e-12 else scale / xi * (q**xi - 1))
    return var, var + (scale + xi * (var - u)) / (1 - xi)


def expectile(x: np.ndarray, tau: float, rounds: int = 120) -> float:
    lo, hi = float(x.min()), float(x.max())
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if tau * np.maximum(x - mid, 0).sum() > (1 - tau) * np.maximum(mid - x, 0).sum():
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_p(lr: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, lr) / 2))


def splitmix(seed: int):
    """The SplitMix64 generator."""
    mask = (1 << 64) - 1
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        yield z ^ (z >> 31)


def block_bootstrap(x: np.ndarray, block: int, replicates: int, seed: int) -> tuple[float, float]:
    """Circular blocks of paired differences: the mean and the one-sided p of a mean above 0."""
    n, rng = len(x), splitmix(seed)
    centred = np.concatenate((x - x.mean(), x - x.mean()))
    blocks = -(-n // block)
    means = np.empty(replicates)
    for k in range(replicates):
        at = np.array([next(rng) % n for _ in range(blocks)])
        means[k] = centred[(at[:, None] + np.arange(block)).ravel()[:n]].mean()
    return float(x.mean()), float((1 + (means >= x.mean()).sum()) / (replicates + 1))


def stationary_bootstrap(x: np.ndarray, length: float, replicates: int, seed: int) -> tuple[float, float, float, float]:
    """Geometric blocks: the mean, a two-sided p and the 95 % interval."""
    n, rng = len(x), splitmix(seed)
    means = np.empty(replicates)
    for k in range(replicates):
        at, total = next(rng) % n, 0.0
        for _ in range(n):
            total += x[at]
            at = next(rng) % n if (next(rng) >> 11) / (1 << 53) < 1 / length else (at + 1) % n
        means[k] = total / n
    mean = float(x.mean())
    p = (1 + (np.abs(means - mean) >= abs(mean)).sum()) / (replicates + 1)
    return mean, float(p), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def evenly(x: np.ndarray, most: int = 512) -> np.ndarray:
    """Rows in lexicographic order, at most ``most`` evenly spaced ones."""
    x = x[np.lexsort(x.T[::-1])]
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)]


def mmd(a: np.ndarray, b: np.ndarray) -> float:
    """Squared RBF maximum mean discrepancy, bandwidth by the median distance."""
    z = np.vstack((a, b))
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    scale = np.median(d[d > 0]) if (d > 0).any() else 1.0
    k = np.exp(-d / scale)
    n = len(a)
    return float(k[:n, :n].mean() + k[n:, n:].mean() - 2 * k[:n, n:].mean())


#: Rows of a block of pairs.
BLOCK = 2048


def _pairs(x: np.ndarray, w: np.ndarray):
    """Blocks of squared distances of different rows, each pair once, with the product of their weights."""
    norms = (x * x).sum(1)
    for i in range(0, len(x), BLOCK):
        for j in range(i, len(x), BLOCK):
            d = norms[i : i + BLOCK, None] + norms[None, j : j + BLOCK] - 2 * (x[i : i + BLOCK] @ x[j : j + BLOCK].T)
            ww = w[i : i + BLOCK, None] * w[None, j : j + BLOCK]
            if i == j:
                upper = np.triu_indices(len(d), 1)
                d, ww = d[upper], ww[upper]
            yield np.maximum(d, 0).ravel(), ww.ravel()


def median_distance(x: np.ndarray, w: np.ndarray, bins: int = 1 << 16, most: int = 1 << 22) -> float:
    """The median of the squared distances of all pairs of different rows, of weight ``w``: exact, in blocks.

    Histograms tell the interval of the middle, until its distances can be held at once.
    """
    n = len(x) * (len(x) - 1) // 2
    if not n:
        return 1.0
    total = int(round((w.sum() ** 2 - (w * w).sum()) / 2))
    # one distance, or the mean of two; the first sum of weights that reaches it
    middle = ((total - 1) // 2 + 0.5, total // 2 + 0.5)
    lo, hi = 0.0, float(4 * (x * x).sum(1).max() * (1 + 1e-9) + 1e-300)
    while n > most:
        step, below = (hi - lo) / bins, 0.0
        weight, count = np.zeros(bins), np.zeros(bins)
        for d, ww in _pairs(x, w):
            below += ww[d < lo].sum()
            inside = (d >= lo) & (d < hi)
            at = np.minimum(((d[inside] - lo) / step).astype(np.int64), bins - 1)
            weight += np.bincount(at, ww[inside], bins)
            count += np.bincount(at, minlength=bins)
        first, last = (int(np.searchsorted(below + np.cumsum(weight), m)) for m in middle)
        # a bin more on either side, for rounding
        first, last = max(0, first - 1), min(bins - 1, last + 1)
        if (first, last) == (0, bins - 1) or lo + (last - first + 1) * step <= np.nextafter(lo, np.inf):
            break
        n, lo, hi = int(count[first : last + 1].sum()), lo + first * step, lo + (last + 1) * step
    below, kept = 0.0, []
    for d, ww in _pairs(x, w):
        below += ww[d < lo].sum()
        inside = (d >= lo) & (d < hi)
        kept.append((d[inside], ww[inside]))
    d, ww = (np.concatenate(v) for v in zip(*kept, strict=True))
    order = np.argsort(d, kind="stable")
    upto = below + np.cumsum(ww[order])
    return float(np.mean([d[order[min(int(np.searchsorted(upto, m)), len(d) - 1)]] for m in middle]))


def mmd_whole(a: np.ndarray, b: np.ndarray) -> float:
    """``mmd`` over any number of rows: equal rows are one of some weight, kernel sums are taken in blocks."""
    z, at = np.unique(np.vstack((a, b)), axis=0, return_inverse=True)
    at = at.ravel()
    wa, wb = np.bincount(at[: len(a)], minlength=len(z)).astype(float), np.bincount(at[len(a) :], minlength=len(z)).astype(float)
    scale = median_distance(z, wa + wb)
    # the squared norm of the difference of the mean embeddings: one weight a row
    c = wa / len(a) - wb / len(b)
    return float((c * c).sum() + 2 * sum((np.exp(-d / scale) * ww).sum() for d, ww in _pairs(z, c)))


def effective_rank(cov: np.ndarray) -> float:
    v = np.maximum(np.linalg.eigvalsh(cov), 0)
    p = v[v > 0] / v.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def rank_auc(labels: np.ndarray, scores: np.ndarray) -> float:
    """Area under the curve in either direction; ties by average rank."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0:
        return float("nan")
    auc = (pd.Series(scores).rank().to_numpy()[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    return float(max(auc, 1 - auc))


def two_sample_auc(a: np.ndarray, b: np.ndarray, seed: int = 20260801, held_out: float = 0.3, ridge: float = 1e-6) -> float:
    """How well a linear discriminant tells the rows of two samples apart, on rows that it has not seen."""
    if min(len(a), len(b)) < 4:
        return float("nan")
    rng = np.random.default_rng(seed)
    parts = []
    for x in (a, b):
        order, k = rng.permutation(len(x)), max(1, int(len(x) * held_out))
        parts.append((x[order[:k]], x[order[k:]]))
    (a_test, a_train), (b_test, b_train) = parts
    pooled = np.vstack((a_train, b_train))
    centre, scale = pooled.mean(0), pooled.std(0, ddof=1)
    scale[scale == 0] = 1.0
    a_train, b_train = (a_train - centre) / scale, (b_train - centre) / scale
    cov = np.atleast_2d(np.cov(np.vstack((a_train, b_train)), rowvar=False, ddof=1))
    direction = np.linalg.solve(cov + np.eye(len(cov)) * ridge, b_train.mean(0) - a_train.mean(0))
    test = np.vstack(((a_test - centre) / scale, (b_test - centre) / scale))
    return rank_auc(np.repeat((0, 1), (len(a_test), len(b_test))), test @ direction)


def mmd_unbiased(a: np.ndarray, b: np.ndarray, bandwidth: float = 1.0) -> float:
    """Squared RBF maximum mean discrepancy without the pairs of a row with itself, at least 0."""

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-((x[:, None] - y[None]) ** 2).sum(-1) / (2 * bandwidth**2))

    aa, bb = kernel(a, a), kernel(b, b)
    own = sum((k.sum() - np.trace(k)) / (len(k) * (len(k) - 1)) for k in (aa, bb))
    return float(max(0.0, own - 2 * kernel(a, b).mean()))


def joint_drift(a: np.ndarray, b: np.ndarray, most: int = 512) -> list[tuple[str, float]]:
    """Distances of two samples' joint distributions, each by at most ``most`` evenly spaced rows."""
    a, b = (x[np.isfinite(x).all(1)] for x in (a, b))
    if min(len(a), len(b)) < 2:
        return []
    a, b = evenly(a, most), evenly(b, most)
    cov_a, cov_b = (np.atleast_2d(np.cov(x, rowvar=False, ddof=1)) for x in (a, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        corr_a, corr_b = (np.atleast_2d(np.nan_to_num(np.corrcoef(x, rowvar=False), nan=0.0)) for x in (a, b))
    if a.shape[1] == 1:
        corr_a = corr_b = np.ones((1, 1))
    eigen_a, eigen_b = (np.maximum(np.linalg.eigvalsh(c), 0) for c in (cov_a, cov_b))
    return [
        ("correlation_distance", float(np.linalg.norm(corr_b - corr_a) / max(np.linalg.norm(corr_a), 1e-12))), ("eigenvalue_distance", float(np.linalg.norm(eigen_b - eigen_a))),
        ("reference_rank", effective_rank(cov_a)), ("current_rank", effective_rank(cov_b)), ("mmd_rbf", mmd_unbiased(a, b)), ("auc", two_sample_auc(a, b)),
    ]


def linear_cka(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(0), b - b.mean(0)
    return float((np.linalg.norm(a.T @ b) ** 2) / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b)))


def per_group(panel: DataFrame, kernel: Callable[[np.ndarray, list[str]], list[tuple[str, float]]], by: str = "panel", value: str = "r") -> DataFrame:
    """Apply a kernel to each panel of ``by, timestamp, symbol, value``: rows ``by, name, value``.

    The panel is pivoted inside the task; timestamps with a missing asset are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="timestamp", columns="symbol", values=value).sort_index().dropna()
        rows = kernel(wide.to_numpy(float), list(wide.columns)) if len(wide) > 2 else []
        return pd.DataFrame([(pdf[by].iloc[0], k, float(v)) for k, v in rows], columns=[by, "name", "value"])

    kind = dict(panel.dtypes)[by]
    return panel.select(by, "timestamp", "symbol", F.col(value)).groupBy(by).applyInPandas(run, f"{by} {kind}, name string, value double")


def oracle_loss(estimate: np.ndarray, sample: np.ndarray, population: np.ndarray) -> tuple[float, float, float]:
    """Squared Frobenius losses of an estimate and of the sample matrix, and the improvement in percent (PRIAL)."""
    a, b = (float(np.square(x - population).sum()) for x in (estimate, sample))
    return a, b, 100 * (1 - a / b) if b > 0 else 0.0
