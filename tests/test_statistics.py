import numpy as np
import pytest
from pyspark.sql import functions as F

import priceloom.operators.joins as joins
import priceloom.operators.quantile as quantile
from priceloom.functions.scalars import (
    bounded,
    direction,
    highly_correlated,
    implied_discount,
    lookup_label,
    negative_sentence,
    polarity,
    strength,
)
from priceloom.operators.correlation import (
    category_cross_correlation,
    correlation_matrix,
    encoded_correlation_matrix,
    extreme_links,
    strongest_pairs,
    target_correlations,
)
from priceloom.operators.encode import encode_category, one_hot_vector
from priceloom.operators.histogram import histogram
from priceloom.operators.joins import lookup_join
from priceloom.operators.metrics import evaluate
from priceloom.operators.ordinal import with_ordinal, with_running_total
from priceloom.operators.quantile import clip_between, clip_upper, exact_quantiles, quantile_row
from priceloom.operators.scale import normalize_features
from priceloom.operators.summary import category_summary, describe_features, percentile_rank
from priceloom.schema import NUMERIC

PROBS = [0.0, 0.02, 0.25, 0.5, 0.97, 1.0]


def column(spark, values, partitions=8):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(partitions)


def distributions():
    rng = np.random.default_rng(7)
    return {
        "prices": np.round(rng.lognormal(6, 2, 5000), 2),
        "signed": rng.normal(0, 50, 3001),
        "ties": rng.integers(0, 5, 4000).astype(float),
        "hot": np.concatenate([np.full(4000, 19.99), rng.random(2000) * 40]),
        "zeros": np.concatenate([np.zeros(100), -np.arange(50.0), np.arange(50.0)]),
        "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 500), -(10.0 ** rng.integers(-300, 300, 500))]),
        "one": np.array([3.5]),
    }


@pytest.mark.parametrize("name", list(distributions()))
@pytest.mark.parametrize("sort_rows", [200_000, 3])
def test_quantiles_match_numpy(spark, monkeypatch, name, sort_rows):
    monkeypatch.setattr(quantile, "SORT_ROWS", sort_rows)
    values = distributions()[name]
    got = {r.prob: r.value for r in exact_quantiles(column(spark, values), "x", PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_quantiles_with_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SORT_ROWS", 2)
    values = [-np.inf] * 3 + list(range(10)) + [np.inf] * 3
    got = {r.prob: r.value for r in exact_quantiles(column(spark, values), "x", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: -np.inf, 0.5: 4.5, 1.0: np.inf}


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_by_group_with_a_hot_group(spark, monkeypatch, small):
    monkeypatch.setattr(quantile, "SORT_ROWS", 50)
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.lognormal(3, 1, 3000), "a": rng.random(40), "b": np.full(500, 2.0), "c": np.array([1.0, 9.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, "x", PROBS, ("g",)).collect()}
    assert len(got) == len(groups) * len(PROBS)
    for (g, p), value in got.items():
        assert value == pytest.approx(np.quantile(groups[g], p), rel=1e-12)


def test_quantiles_skip_missing_and_empty(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    assert quantile_row(df, "x", {"m": 0.5}).first().m == 2.0
    assert quantile_row(df.where("x > 10 and not isnan(x)"), "x", {"m": 0.5}).first().m is None


def test_clips_keep_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,), (50.0,)], "x double")
    got = [r.x for r in clip_upper(df, "x", 0.5).collect()]
    assert got[0] is None and np.isnan(got[1]) and got[2:] == [1.0, 3.0, 3.0]
    got = [r.x for r in clip_between(df, "x", 0.5, 0.5).collect()]
    assert got[0] is None and np.isnan(got[1]) and got[2:] == [3.0, 3.0, 3.0]


@pytest.mark.parametrize("values", [
    np.arange(0, 81, 8.0).repeat(3), np.random.default_rng(1).normal(0, 3, 2000), np.array([5.0, 5.0]),
    np.linspace(0, 1, 41), np.array([0.1, 0.2, 0.3, 0.7]),
])
@pytest.mark.parametrize("bins", [40, 25])
def test_histogram_matches_numpy(spark, values, bins):
    counts, edges = np.histogram(values, bins=bins)
    got = histogram(column(spark, values), "x", bins).orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_start for r in got] == pytest.approx(edges[:-1].tolist())


def test_clipped_histogram_and_empty(spark):
    values = np.random.default_rng(2).lognormal(3, 1, 1000)
    clipped = np.clip(values, np.quantile(values, 0.02), np.quantile(values, 0.98))
    got = histogram(column(spark, values), "x", 40, 0.02, 0.98).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(clipped, bins=40)[0].tolist()
    assert histogram(column(spark, values).where("x < 0"), "x").count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_ordinal_and_running_total(spark, partitions):
    rows = [(f"k{i:04d}", i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(partitions)
    got = {r.k: r.row_id for r in with_ordinal(df, ["k"]).collect()}
    assert got == {k: i for i, (k, _) in enumerate(rows)}
    total = np.cumsum([n for _, n in rows])
    got = {r.k: r.upto for r in with_running_total(df, "k", "n", "upto").collect()}
    assert got == {k: total[i] for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("limit", [100_000, 1])
def test_lookup_join_keeps_every_row_of_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 50))
                                   .when(F.col("id") % 6 == 0, "hot").alias("k"))
    table = big.groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_join(big, table, ["k"], salt_on=["id"])
    assert got.columns == ["id", "k", "n"]
    assert got.count() == 3000
    assert {r.k: r.n for r in got.distinct().groupBy("k", "n").count().collect()} == {
        r.k: r.n for r in table.collect()}


@pytest.fixture(scope="module")
def small_listings(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        category = [None, "Zeta|x", "Ärger|y", "alpha|z", "Alpha"][i % 5] if i % 3 else "Zeta|q"
        actual = float(rng.uniform(10, 1000))
        rows.append((f"P{i:03d}", category, actual, actual * float(rng.uniform(0.2, 1)), float(rng.integers(0, 90)),
                     float(rng.integers(10, 51)) / 10, float(rng.integers(1, 9999))))
    return spark.createDataFrame(rows, "product_id string, category string, " + ", ".join(f"{c} double" for c in NUMERIC))


def test_encodings_match_pandas(spark, small_listings):
    pdf = small_listings.toPandas().set_index("product_id")
    top = pdf["category"].fillna("Unknown").str.split("|").str[0]
    names = sorted(top.unique())

    def encoded(method, **options):
        df, columns = encode_category(small_listings, method, **options)
        return df.toPandas().set_index("product_id").loc[pdf.index][columns], columns

    label, columns = encoded("label")
    assert columns == ["category_label"] and (label["category_label"] == top.map(names.index)).all()
    share, columns = encoded("frequency")
    assert np.allclose(share["category_freq"], top.map(top.value_counts(normalize=True)))
    for target in ("discount_percentage", "discounted_price"):
        mean, columns = encoded("target", target_col=target)
        assert np.allclose(mean["category_target"], top.map(pdf.groupby(top)[target].mean()))
    hot, columns = encoded("onehot")
    assert columns == [f"cat_{n}" for n in names] and (hot.to_numpy().sum(axis=1) == 1).all()
    vector, _ = one_hot_vector(small_listings)
    for row in vector.limit(20).collect():
        assert row.category_vector.toArray().argmax() == names.index(top[row.product_id])
    with pytest.raises(ValueError, match="unknown encoding"):
        encode_category(small_listings, "hash")


@pytest.mark.parametrize("method", ["label", "frequency", "target"])
def test_encodings_without_broadcast(spark, small_listings, monkeypatch, method):
    expected, (name,) = encode_category(small_listings, method)
    expected = {r.product_id: r[name] for r in expected.collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    got, _ = encode_category(small_listings, method)
    assert {r.product_id: r[name] for r in got.collect()} == pytest.approx(expected)


def test_target_encoding_of_unseen_category(spark, small_listings):
    train = small_listings.where("category is not null")
    got, _ = encode_category(small_listings, "target", fit_on=train)
    mean = train.agg(F.avg("discount_percentage")).first()[0]
    unknown = got.where("category is null").select("category_target").distinct().collect()
    assert len(unknown) == 1 and unknown[0][0] == pytest.approx(mean)


def test_scaling(spark, small_listings):
    df = small_listings.withColumn("rating", F.lit(4.0))
    got = normalize_features(df).agg(*[f(c).alias(f"{c}_{f.__name__}") for c in NUMERIC for f in (F.min, F.max)]).first()
    assert (got.actual_price_min, got.actual_price_max) == (0.0, 1.0)
    assert (got.rating_min, got.rating_max) == (0.0, 0.0)
    part = small_listings.where("actual_price between 300 and 600")
    got = normalize_features(small_listings, ["actual_price"], fit_on=part).agg(F.min("actual_price"), F.max("actual_price"))
    assert tuple(got.first()) == (0.0, 1.0)


def test_correlations_match_pandas(spark, small_listings):
    pdf = small_listings.toPandas()
    got = {(r.row_feature, r.col_feature): r.r for r in correlation_matrix(small_listings).collect()}
    expected = pdf[NUMERIC].corr()
    assert all(got[a, b] == pytest.approx(expected.loc[a, b]) for a in NUMERIC for b in NUMERIC)
    top = pdf["category"].fillna("Unknown").str.split("|").str[0]
    for method, name in (("label", "category_label"), ("frequency", "category_freq"), ("target", "category_target")):
        codes = {"label": top.map(sorted(top.unique()).index), "frequency": top.map(top.value_counts(normalize=True)),
                 "target": top.map(pdf.groupby(top)["discount_percentage"].mean())}[method]
        expected = pdf[NUMERIC].assign(**{name: codes}).corr()
        got = {(r.row_feature, r.col_feature): r.r for r in encoded_correlation_matrix(small_listings, method).collect()}
        assert len(got) == 36
        assert all(got[a, b] == pytest.approx(expected.loc[a, b]) for a in expected for b in expected)
    cross = {(r.category, r.feature): r.r for r in category_cross_correlation(small_listings).collect()}
    for name in top.unique():
        for c in NUMERIC:
            assert cross[name, c] == pytest.approx((top == name).astype(float).corr(pdf[c]))
    with pytest.raises(ValueError, match="unknown encoding"):
        encoded_correlation_matrix(small_listings, "hash")


def test_constant_column_and_single_category_give_null(spark, small_listings):
    df = small_listings.withColumns({"rating": F.lit(4.0), "category": F.lit("A")})
    got = {(r.row_feature, r.col_feature): r.r for r in correlation_matrix(df).collect()}
    assert got["rating", "actual_price"] is None and got["rating", "rating"] is None
    assert got["actual_price", "actual_price"] == 1.0
    assert {r.r for r in category_cross_correlation(df).collect()} == {None}
    last = target_correlations(correlation_matrix(df)).collect()[-1]
    assert (last.feature, last.r) == ("rating", None)
    assert extreme_links(correlation_matrix(df)).first().negative_feature != "rating"


def test_pairs_break_ties_by_name(spark):
    rows = [(a, b, 0.9 if {a, b} == {"rating", "rating_count"} else -0.5) for a in NUMERIC for b in NUMERIC]
    matrix = spark.createDataFrame(rows, "row_feature string, col_feature string, r double")
    got = [(r.first_feature, r.second_feature, r.overlap) for r in strongest_pairs(matrix).collect()]
    assert got == [("rating", "rating_count", True), ("discounted_price", "rating_count", False),
                   ("discounted_price", "rating", False)]


def test_wording(spark):
    rows = [(0.61,), (0.6,), (0.31,), (0.3,), (0.0,), (-0.7,), (-0.71,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "r double")
    r = F.col("r")
    got = df.select(strength(r), direction(r), polarity(r), highly_correlated(r)).collect()
    assert [x[0] for x in got] == ["strongly", "moderately", "moderately", "weakly", "weakly", "strongly", "strongly",
                                   "weakly", "weakly"]
    assert [x[1] for x in got] == ["higher"] * 4 + ["lower"] * 5
    assert [x[2] for x in got] == ["positively"] * 4 + ["negatively"] * 5
    assert [x[3] for x in got] == [False] * 6 + [True, False, False]
    got = [x[0] for x in df.select(negative_sentence(F.lit("Rating"), r)).collect()]
    assert got[5].startswith("The most negative is **Rating** (r = -0.70) — higher rating")
    assert got[4].startswith("No strong negative") and got[7].startswith("No strong negative")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [x[0] for x in keys.select(lookup_label(F.col("k"), {"a": "A"})).collect()] == ["A", "b"]
    assert [x[0] for x in keys.select(lookup_label(F.col("k"), {"a": "A"}, F.lit(""))).collect()] == ["A", ""]


def test_row_arithmetic(spark):
    df = spark.createDataFrame([(100.0, 80.0), (0.0, 5.0), (-1.0, 5.0)], "a double, d double")
    got = [x[0] for x in df.select(implied_discount(F.col("a"), F.col("d"))).collect()]
    assert got == pytest.approx([20.0, 0.0, 0.0])
    odd = spark.createDataFrame([(float("nan"),), (None,), (120.0,), (-3.0,)], "p double")
    got = [x[0] for x in odd.select(bounded(F.col("p"), F.lit(0.0), F.lit(100.0))).collect()]
    assert np.isnan(got[0]) and got[1:] == [None, 100.0, 0.0]


@pytest.mark.parametrize("limit", [100_000, 1])
def test_percentile_rank(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    inf = float("inf")
    data = column(spark, [*np.arange(8.0), 3.0, -inf])
    asked = spark.createDataFrame([(-1.0,), (0.0,), (-0.0,), (3.0,), (4.5,), (7.0,), (4.5,), (inf,), (-inf,)], "value double")
    got = {r.value: r.percent for r in percentile_rank(data, "x", asked).collect()}
    assert got == {-inf: 10.0, -1.0: 10.0, 0.0: 20.0, 3.0: 60.0, 4.5: 70.0, 7.0: 100.0, inf: 100.0}


def test_summary_of_nothing(spark, small_listings):
    empty = small_listings.where("1 = 0")
    assert category_summary(empty).count() == 0
    assert {tuple(r)[1:] for r in describe_features(empty).collect()} == {(None, None, None, None)}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    got = evaluate(df, "y", "p").first()
    assert got.rmse == pytest.approx(np.sqrt(1.25 / 3)) and got.mae == pytest.approx(0.5)
    assert got.r2 == pytest.approx(1 - 1.25 / (14 / 3))
    assert evaluate(df.withColumn("y", F.lit(1.0)), "y", "p").first().r2 is None


def test_too_many_categories_for_columns(small_listings, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    with pytest.raises(ValueError, match="one_hot_vector"):
        encode_category(small_listings, "onehot")
