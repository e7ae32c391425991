"""Principal components of the Min-Max scaled features.

Scaling without clipping is linear, so ranges, means and covariances of the raw columns, all from
one aggregate, give the covariances of the scaled ones. The small eigenproblem is solved on the
driver, and scores are plain column arithmetic: one pass to fit, one narrow pass to score.
"""

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scalars import bounded, lookup_label
from priceloom.operators.moments import fit_quality, least_squares, moment_aggregates, moments_of_row, pooled
from priceloom.operators.scale import normalize_features
from priceloom.operators.selection import both_sides
from priceloom.operators.split import IS_TEST, with_split
from priceloom.operators.summary import running_share
from priceloom.schema import DISCOUNT_TARGET, KEY, LOADING_LABELS, NUMERIC
from priceloom.session import held


@dataclass
class Components:
    """A fitted decomposition; the largest loading of every component is positive."""

    columns: list[str]
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    loadings: np.ndarray
    ratio: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.ratio))]


def _decompose(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors as columns, and variance ratios, largest first."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return vectors, values / (values.sum() or 1.0)


def fit_pca(df: DataFrame, columns: list[str] | None = None, k: int | None = None) -> Components:
    """Scale to [0, 1] and decompose, in one pass over the listings."""
    columns = columns or NUMERIC
    limits = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*moment_aggregates(columns), *limits).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    m = moments_of_row(row, columns)
    low = np.array([row[f"lo{i}"] for i in range(len(columns))])
    high = np.array([row[f"hi{i}"] for i in range(len(columns))])
    span = np.where(high > low, high - low, np.inf)
    vectors, ratio = _decompose(m.cov / np.outer(span, span))
    k = k or len(columns)
    return Components(list(columns), low, high, (m.mean - low) / span, vectors[:, :k], ratio[:k])


def pca_scores(df: DataFrame, fitted: Components) -> DataFrame:
    """Add one column per component, ``PC1`` first, computed from the raw columns of ``df``."""
    parts = []
    for c, lo, hi, mean in zip(fitted.columns, fitted.low, fitted.high, fitted.mean):
        share = (F.col(c) - float(lo)) / float(hi - lo) if hi > lo else F.lit(0.0)
        parts.append(bounded(share, F.lit(0.0), F.lit(1.0)) - float(mean))
    columns = {
        name: reduce(add, [p * float(w) for p, w in zip(parts, fitted.loadings[:, j])])
        for j, name in enumerate(fitted.names)
    }
    return df.withColumns(columns)


def pca_projection(df: DataFrame, fitted: Components, colour: str) -> DataFrame:
    """The first two components and a column to colour by."""
    return pca_scores(df, fitted).select(KEY, "PC1", "PC2", F.col(colour).alias("colour"))


def explained_variance(spark, fitted: Components) -> DataFrame:
    """Variance ratio per component and its running total."""
    rows = [(i + 1, float(v)) for i, v in enumerate(fitted.ratio)]
    return running_share(spark.createDataFrame(rows, "pc bigint, ratio double"), "pc", "ratio")


def loadings_table(spark, fitted: Components) -> DataFrame:
    """One row per feature and component."""
    rows = [
        (c, j + 1, float(fitted.loadings[i, j])) for i, c in enumerate(fitted.columns) for j in range(len(fitted.ratio))
    ]
    return spark.createDataFrame(rows, "feature string, pc bigint, loading double")


def components_needed(variance: DataFrame) -> DataFrame:
    """Fewest components that reach 90 % and 95 %, and what is left beyond the latter.

    Null when no number of components reaches the share.
    """
    n90 = F.min(F.when(F.col("cumulative") >= 0.90, F.col("pc")))
    n95 = F.min(F.when(F.col("cumulative") >= 0.95, F.col("pc")))
    share95 = F.min(F.when(F.col("cumulative") >= 0.95, F.col("cumulative")))
    return variance.agg(
        n90.alias("n_90"), n95.alias("n_95"),
        (F.max("pc") - n95).alias("remaining"), (1 - share95).alias("remaining_share"),
    )


def loading_sentences(loadings: DataFrame, threshold: float = 0.25) -> DataFrame:
    """The features that raise and lower each component, strongest first."""
    label = lookup_label(F.col("feature"), LOADING_LABELS)
    text = F.concat(F.lit("**"), label, F.lit("** ("), F.format_string("%+.2f", "loading"), F.lit(")"))
    item = F.struct((-F.abs("loading")).alias("order"), "feature", text.alias("text"))

    def side(keep):
        kept = F.array_sort(F.collect_list(F.when(keep, item)))
        joined = F.concat_ws(", ", F.transform(kept, lambda x: x["text"]))
        return F.when(F.size(kept) > 0, joined).otherwise("none above threshold")

    return loadings.groupBy("pc").agg(
        side(F.col("loading") > threshold).alias("rises_with"), side(F.col("loading") < -threshold).alias("falls_with")
    )


def component_regression(df: DataFrame, target: str = DISCOUNT_TARGET, columns: list[str] | None = None,
                         fit_on: str = "train", key: str = KEY) -> DataFrame:
    """Test R2 of least squares on the first k components, for every k.

    Scores are a linear map of the scaled features, so the moments of the scaled features on both
    sides of the split give all models: one pass for the ranges, one for the moments. ``fit_on``
    names the rows that scaling and components see: ``train``, or ``all`` of them.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    columns = columns or NUMERIC
    names = [c + "_scaled" for c in columns]
    with held(with_split(df, key).select(IS_TEST, *columns, F.col(target).alias("_target"))) as ready:
        fitted = ready.where(~F.col(IS_TEST)) if fit_on == "train" else ready
        scaled = normalize_features(ready, columns, fit_on=fitted, suffix="_scaled")
        train, test = both_sides(scaled, [*names, "_target"])
    seen = train if fit_on == "train" else pooled(train, test)
    f = seen.index(names)
    vectors, ratio = _decompose(seen.cov[np.ix_(f, f)])
    share = np.cumsum(ratio)
    turn = np.zeros((len(names) + 1, len(names) + 1))
    turn[: len(names), : len(names)] = vectors
    turn[-1, -1] = 1.0
    scores = [f"PC{i + 1}" for i in range(len(names))]
    sides = [type(m)([*scores, "_target"], m.n, m.mean @ turn, turn.T @ m.cov @ turn) for m in (train, test)]
    rows = []
    for k in range(1, len(names) + 1):
        model = least_squares(sides[0], scores[:k], "_target")
        rows.append((k, float(share[k - 1]), fit_quality(sides[1], scores[:k], "_target", *model)[0]))
    return df.sparkSession.createDataFrame(rows, "k bigint, cumulative double, r2 double")
