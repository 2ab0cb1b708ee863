"""Portfolio weights from daily results. Moments are aggregated in Spark; what reaches the driver is one number a pair of accounts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .market import daily


def moments(trades: DataFrame, most: int = 200) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Accounts, mean daily result, and covariance over all trading days (a day without trades counts as zero).

    ``most`` bounds the accounts: the matrix is meant for a portfolio, not for a population.
    """
    d = daily(trades).cache()
    n = d.select("date").distinct().count()
    sums = {r.account_name: r.s for r in d.groupBy("account_name").agg(F.sum("pnl").alias("s")).limit(most + 1).collect()}
    if len(sums) > most:
        raise ValueError(f"more than {most} accounts")
    a, b = d.select("date", F.col("account_name").alias("a"), F.col("pnl").alias("x")), d.select("date", F.col("account_name").alias("b"), F.col("pnl").alias("y"))
    cross = a.join(b, "date").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy")).collect()
    d.unpersist()
    names = sorted(sums)
    at = {x: i for i, x in enumerate(names)}
    mean = np.array([sums[x] for x in names]) / max(n, 1)
    cov = -np.outer(mean, mean)
    for r in cross:
        i, j = at[r.a], at[r.b]
        cov[i, j] = cov[j, i] = r.xy / n - mean[i] * mean[j]
    return names, mean, cov


def _simplex(w: np.ndarray) -> np.ndarray:
    """Nearest weights that are not negative and sum to 1."""
    u = np.sort(w)[::-1]
    k = np.arange(1, len(w) + 1)
    theta = (np.cumsum(u) - 1) / k
    return np.maximum(w - theta[np.nonzero(u > theta)[0][-1]], 0)


def _descend(gradient, n: int, rate: float, steps: int = 3000) -> np.ndarray:
    w = np.full(n, 1 / n)
    for _ in range(steps):
        w = _simplex(w - rate * gradient(w))
    return w


def weights(trades: DataFrame, method: str = "min_variance", *, risk_aversion: float = 1.0) -> dict[str, float]:
    """Long-only weights: min_variance, mean_variance, risk_parity or kelly (half the growth-optimal shares, clipped)."""
    names, mean, cov = moments(trades)
    scale = float(np.trace(cov)) or 1.0
    if method == "min_variance":
        w = _descend(lambda x: 2 * cov @ x / scale, len(names), 0.2)
    elif method == "mean_variance":
        w = _descend(lambda x: (2 * risk_aversion * cov @ x - mean * np.sqrt(scale)) / scale, len(names), 0.2)
    elif method == "risk_parity":
        w = np.full(len(names), 1 / len(names))
        for _ in range(500):  # shares of risk move towards each other
            share = w * (cov @ w)
            w = w * np.sqrt(share.mean() / np.maximum(share, 1e-12 * scale))
            w /= w.sum()
    elif method == "kelly":
        w = np.clip(mean / np.maximum(np.diag(cov), 1e-12) / 2, 0, 0.25)
        w = w / w.sum() if w.sum() > 1 else w
    else:
        raise ValueError(method)
    return dict(zip(names, w.tolist(), strict=True))
