"""Counts, means and covariances of a few columns in one pass, and what follows from them."""

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    columns: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def index(self, names: list[str]) -> list[int]:
        return [self.columns.index(c) for c in names]


def moment_aggregates(columns: list[str]) -> list:
    """Aggregate expressions: count, means and population covariances.

    For d columns these are d(d+1)/2 aggregates in one plan and a d x d matrix on the driver: meant for the
    columns of a feature set, of which there are as many as the caller names.
    """
    pairs = combinations_with_replacement(range(len(columns)), 2)
    return [
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ]


def moments_of_row(row, columns: list[str]) -> Moments:
    """Read one row of ``moment_aggregates``."""
    d = len(columns)
    cov = np.zeros((d, d))
    for i, j in combinations_with_replacement(range(d), 2):
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return Moments(list(columns), row["n"], np.array([row[f"m{i}"] for i in range(d)]), cov)


def moments(df: DataFrame, columns: list[str]) -> Moments | None:
    """Moments of the rows of ``df``, or None when it has none."""
    row = df.agg(*moment_aggregates(columns)).first()
    return moments_of_row(row, columns) if row["n"] else None


def split_moments(df: DataFrame, columns: list[str], flag: str) -> dict[bool, Moments]:
    """Moments of both sides of a boolean column, in one pass."""
    rows = df.groupBy(flag).agg(*moment_aggregates(columns)).collect()
    return {r[flag]: moments_of_row(r, columns) for r in rows}


def pooled(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of rows taken together."""
    n = a.n + b.n
    gap = b.mean - a.mean
    cov = (a.cov * a.n + b.cov * b.n) / n + np.outer(gap, gap) * (a.n * b.n / n**2)
    return Moments(a.columns, n, a.mean + gap * (b.n / n), cov)


def least_squares(m: Moments, features: list[str], target: str, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of (ridge) least squares; minimum norm when features are collinear."""
    f, (t,) = m.index(features), m.index([target])
    gram = m.cov[np.ix_(f, f)] + np.eye(len(f)) * (alpha / m.n)
    # Scaled to unit diagonal first, so that columns of very different size are told apart.
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1.0
    solution = np.linalg.lstsq(gram / np.outer(size, size), m.cov[f, t] / size, rcond=1e-12)[0] / size
    return solution, float(m.mean[t] - m.mean[f] @ solution)


def fit_quality(m: Moments, features: list[str], target: str, coefficients: np.ndarray, intercept: float):
    """R2 and RMSE of a linear model on the rows that ``m`` describes."""
    f, (t,) = m.index(features), m.index([target])
    spread = m.cov[t, t] - 2 * coefficients @ m.cov[f, t] + coefficients @ m.cov[np.ix_(f, f)] @ coefficients
    bias = m.mean[t] - intercept - m.mean[f] @ coefficients
    mse = max(spread + bias**2, 0.0)
    r2 = 1 - mse / m.cov[t, t] if m.cov[t, t] > 0 else float("nan")
    return float(r2), float(np.sqrt(mse))
