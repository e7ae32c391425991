"""Pearson correlations in long form: one (row_feature, col_feature, r) row per pair."""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scalars import (
    correlation_sentence,
    highly_correlated,
    lookup_label,
    negative_sentence,
    pair_sentence,
)
from priceloom.operators.clean import with_top_category
from priceloom.operators.encode import category_codes
from priceloom.operators.joins import join_materialised, materialise_small
from priceloom.operators.moments import moment_aggregates
from priceloom.schema import FEATURE_CONTEXT, FEATURE_LABELS, NUMERIC, TOP_CATEGORY


def _pearson(covariance: Column, a: Column, b: Column) -> Column:
    """Null, not an error, when either variable is constant."""
    return covariance / F.nullif(a * b, F.lit(0.0))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All pairs, from one aggregate of covariances and deviations."""
    columns = columns or NUMERIC
    pairs = list(combinations(range(len(columns)), 2))
    wide = df.agg(
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )

    def cell(i, j):
        s = F.col(f"s{i}")
        if i == j:
            r = F.when(s > 0, F.lit(1.0))
        else:
            r = _pearson(F.col(f"c{min(i, j)}_{max(i, j)}"), s, F.col(f"s{j}"))
        return F.struct(F.lit(columns[i]).alias("row_feature"), F.lit(columns[j]).alias("col_feature"), r.alias("r"))

    size = range(len(columns))
    return wide.select(F.inline(F.array(*[cell(i, j) for i in size for j in size])))


def encoded_correlation_matrix(df: DataFrame, method: str, target_col: str = "discount_percentage") -> DataFrame:
    """The five numeric columns and the encoded category; one-hot and no method leave it out.

    An encoded category takes one value per category, so its covariances follow from counts and
    means per category. One pass groups the listings; the rest is arithmetic on one row per category.
    """
    if method in (None, "none", "onehot"):
        return correlation_matrix(df)
    names = {"label": "category_label", "frequency": "category_freq", "target": "category_target"}
    if method not in names:
        raise ValueError(f"unknown encoding {method!r}: choose label, frequency, target or onehot")
    groups, _ = materialise_small(with_top_category(df).groupBy(TOP_CATEGORY).agg(*moment_aggregates(NUMERIC)))
    if method == "label":
        codes, small = category_codes(groups)
        coded = join_materialised(groups, codes.withColumnRenamed("category_label", "_e"), small, [TOP_CATEGORY])
    elif method == "frequency":
        total = groups.agg(F.sum("n").alias("_all"))
        coded = groups.crossJoin(F.broadcast(total)).withColumn("_e", F.col("n") / F.col("_all")).drop("_all")
    else:
        coded = groups.withColumn("_e", F.col(f"m{NUMERIC.index(target_col)}"))
    return _from_groups(coded, names[method])


def _from_groups(groups: DataFrame, name: str) -> DataFrame:
    """Correlations of numeric columns and a per-group value ``_e``, from the moments per group."""
    d = len(NUMERIC)
    columns = [*NUMERIC, name]
    mean = [F.col(f"m{i}") for i in range(d)] + [F.col("_e")]
    total = groups.agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * m) / F.sum("n")).alias(f"g{i}")
                                                 for i, m in enumerate(mean)])

    def within(i, j):
        return F.col(f"c{i}_{j}") if j < d else F.lit(0.0)

    def between(i, j):
        return (mean[i] - F.col(f"g{i}")) * (mean[j] - F.col(f"g{j}"))

    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    wide = groups.crossJoin(F.broadcast(total)).agg(
        *[(F.sum(F.col("n") * (within(i, j) + between(i, j))) / F.max("_n")).alias(f"v{i}_{j}") for i, j in cells]
    )

    def cell(i, j):
        a, b = F.sqrt(f"v{i}_{i}"), F.sqrt(f"v{j}_{j}")
        r = F.when(a > 0, F.lit(1.0)) if i == j else _pearson(F.col(f"v{min(i, j)}_{max(i, j)}"), a, b)
        return F.struct(F.lit(columns[i]).alias("row_feature"), F.lit(columns[j]).alias("col_feature"), r.alias("r"))

    return wide.select(F.inline(F.array(*[cell(i, j) for i in range(d + 1) for j in range(d + 1)])))


def category_cross_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every category's 0/1 indicator with every numeric column.

    For an indicator with share p, the covariance with x is p (mean of x inside - mean of x), so
    counts, means and variances per category are enough: no indicator column is made, and the
    listings are read once.
    """
    columns = columns or NUMERIC
    d = range(len(columns))
    groups, _ = materialise_small(with_top_category(df).groupBy(TOP_CATEGORY).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    ))
    total = groups.agg(F.sum("_n").alias("_all"), *[(F.sum(F.col("_n") * F.col(f"m{i}")) / F.sum("_n")).alias(f"g{i}")
                                                    for i in d])
    with_means = groups.crossJoin(F.broadcast(total))
    spreads = [(F.col(f"m{i}") - F.col(f"g{i}")) for i in d]
    deviations = with_means.agg(*[
        F.sqrt(F.sum(F.col("_n") * (F.col(f"v{i}") + spreads[i] * spreads[i])) / F.max("_all")).alias(f"s{i}") for i in d
    ])
    share = F.col("_n") / F.col("_all")
    indicator = F.sqrt(share * (1 - share))
    cells = [F.struct(F.lit(c).alias("feature"), _pearson(share * spreads[i], indicator, F.col(f"s{i}")).alias("r"))
             for i, c in enumerate(columns)]
    joined = with_means.crossJoin(F.broadcast(deviations))
    return joined.select(F.col(TOP_CATEGORY).alias("category"), F.inline(F.array(*cells)))


def target_correlations(matrix: DataFrame, target: str = "discount_percentage") -> DataFrame:
    """Every other feature's correlation with the target, strongest first."""
    rows = matrix.where((F.col("col_feature") == target) & (F.col("row_feature") != target))
    return rows.select(F.col("row_feature").alias("feature"), "r").orderBy(F.abs("r").desc_nulls_last(), "feature")


def extreme_links(matrix: DataFrame, target: str = "discount_percentage") -> DataFrame:
    """The features with the largest and the smallest correlation with the target."""
    rows = target_correlations(matrix, target).where(F.col("r").isNotNull() & ~F.isnan("r"))
    up, down = F.struct("r", "feature"), F.struct("r", "feature")
    return rows.agg(F.max(up).alias("up"), F.min(down).alias("down")).select(
        F.col("up.feature").alias("positive_feature"), F.col("up.r").alias("positive_r"),
        F.col("down.feature").alias("negative_feature"), F.col("down.r").alias("negative_r"),
    )


def strongest_pairs(matrix: DataFrame, columns: list[str] | None = None, target: str = "discount_percentage",
                    limit: int = 3) -> DataFrame:
    """The feature pairs with the largest |r|, leaving out the target; ties by names, descending.

    ``columns`` is the order of the features; by default the numeric columns, then all others of the matrix by name.
    """
    if columns is None:
        found = sorted(r[0] for r in matrix.select("row_feature").distinct().collect())
        columns = [*NUMERIC, *(c for c in found if c not in NUMERIC)]
    order = F.array(*[F.lit(c) for c in columns])
    a, b = F.col("row_feature"), F.col("col_feature")
    kept = matrix.where((a != target) & (b != target) & (F.array_position(order, a) > 0) & (F.array_position(order, a) < F.array_position(order, b)))
    return kept.select(
        a.alias("first_feature"), b.alias("second_feature"), "r", highly_correlated(F.col("r")).alias("overlap")
    ).orderBy(F.abs("r").desc_nulls_last(), F.desc("first_feature"), F.desc("second_feature")).limit(limit)


def insight_sentences(matrix: DataFrame, target: str = "discount_percentage") -> DataFrame:
    """One readable sentence per feature, strongest correlation first."""
    label = lookup_label(F.col("feature"), FEATURE_LABELS)
    context = lookup_label(F.col("feature"), FEATURE_CONTEXT, F.lit(""))
    rows = target_correlations(matrix, target)
    return rows.withColumn("sentence", correlation_sentence(label, F.col("r"), context))


def pair_sentences(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One readable sentence for each of the strongest feature pairs."""
    first = lookup_label(F.col("first_feature"), FEATURE_LABELS)
    second = lookup_label(F.col("second_feature"), FEATURE_LABELS)
    return strongest_pairs(matrix, columns).withColumn("sentence", pair_sentence(first, second, F.col("r")))


def extreme_sentence(matrix: DataFrame) -> DataFrame:
    """The strongest positive link and the wording for the most negative one."""
    label = lookup_label(F.col("negative_feature"), FEATURE_LABELS)
    return extreme_links(matrix).select(
        lookup_label(F.col("positive_feature"), FEATURE_LABELS).alias("positive_label"), "positive_r",
        negative_sentence(label, F.col("negative_r")).alias("negative_sentence"),
    )


def labelled(matrix: DataFrame) -> DataFrame:
    """Readable names in place of column names."""
    names = {c: lookup_label(F.col(c), FEATURE_LABELS) for c in ("row_feature", "col_feature")}
    return matrix.withColumns(names)
