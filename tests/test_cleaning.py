import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from priceloom.functions.cleaning import digits_to_double, missing_to_null, price_to_double, top_level
from priceloom.operators.clean import clean_listings, feature_target, rejected_counts
from priceloom.schema import DISCOUNT_FEATURES, NUMERIC, PRICE_FEATURES, RAW_COLUMNS
from priceloom.sources.listings import read_listings_csv

# text, as a price, as digits
EDGE = [
    ("₹1,299", 1299.0, 1299.0),
    ("₹ 999", 999.0, 999.0),
    (" ₹ 1,0\t", 10.0, 10.0),
    ("4.2 out of 5", None, 4.25),
    ("64%", None, 64.0),
    ("-5", -5.0, 5.0),
    ("+5", 5.0, 5.0),
    ("5.", 5.0, 5.0),
    (".5", 0.5, 0.5),
    ("1e5", 100000.0, 15.0),
    ("1_000", 1000.0, 1000.0),
    ("1__0", None, 10.0),
    ("_1", None, 1.0),
    ("|", None, None),
    (".", None, None),
    ("1.2.3", None, None),
    ("1.0d", None, 1.0),
    ("1F", None, 1.0),
    ("0x1p3", None, 13.0),
    ("inf", math.inf, None),
    ("-Infinity", -math.inf, None),
    ("", None, None),
    ("५", None, None),
    (None, None, None),
]


def test_edge_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(EDGE)], "id int, t string")
    got = df.select("id", "t", price_to_double("t").alias("p"), digits_to_double("t").alias("d")).orderBy("id").collect()
    assert [(r.t, r.p, r.d) for r in got] == EDGE


def test_nan_text_is_a_nan_price(spark):
    row = spark.createDataFrame([("NaN",)], "t string").select(price_to_double("t").alias("p")).first()
    assert math.isnan(row.p)


@pytest.mark.parametrize("function, text", [(price_to_double, "cheap"), (digits_to_double, "1.2.3")])
def test_strict_fails(spark, function, text):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="not a"):
        df.select(function("t", strict=True)).collect()


def test_strict_accepts_missing(spark):
    df = spark.createDataFrame([(None,), ("₹1,0",)], "t string")
    got = df.select(price_to_double("t", strict=True).alias("p"), digits_to_double("t", strict=True).alias("d")).collect()
    assert [tuple(r) for r in got] == [(None, None), (10.0, 10.0)]


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("1.#IND",), ("n/a",), ("",), ("na",), ("0",), (None,)], "t string")
    got = [r[0] for r in df.select(missing_to_null("t")).collect()]
    assert got == [None, None, None, None, None, "na", "0", None]


def test_top_level(spark):
    df = spark.createDataFrame([("A&B|C|D",), ("A",), ("",), (None,), ("|x",)], "category string")
    assert [r[0] for r in df.select(top_level("category")).collect()] == ["A&B", "A", "", "Unknown", ""]


@pytest.fixture()
def csv(tmp_path, sample_rows):
    path = str(tmp_path / "sample.csv")
    pd.DataFrame(sample_rows).to_csv(path, index=False)
    return path


def test_csv_values(spark, csv):
    df = clean_listings(read_listings_csv(spark, csv)).orderBy("product_id")
    assert dict(df.dtypes)["actual_price"] == dict(df.dtypes)["discounted_price"] == "double"
    first = df.first()
    assert (first.discounted_price, first.actual_price) == (399.0, 1099.0)
    assert first.discount_percentage == 64.0
    assert first.rating_count == 24269.0
    assert df.columns == RAW_COLUMNS


def test_rows_with_a_missing_number_are_dropped(spark, tmp_path, sample_rows):
    rows = pd.DataFrame(sample_rows)
    rows.loc[1, "discount_percentage"] = None
    rows.loc[2, "rating"] = "NA"
    path = str(tmp_path / "nulls.csv")
    rows.to_csv(path, index=False)
    raw = read_listings_csv(spark, path)
    assert [r.product_id for r in clean_listings(raw).collect()] == ["L-01"]
    report = rejected_counts(raw).first()
    assert (report.rows_read, report.rows_dropped, report.bad_rating, report.bad_actual_price) == (3, 2, 1, 0)


def test_quotes_line_breaks_and_extra_columns(spark, tmp_path, sample_rows):
    rows = pd.DataFrame(sample_rows).assign(extra=["x", "y", "z"])
    rows.loc[0, "review_content"] = 'says "good",\nthen more'
    path = str(tmp_path / "quoted.csv")
    rows[list(reversed(rows.columns))].to_csv(path, index=False)
    df = clean_listings(read_listings_csv(spark, path))
    assert df.count() == 3
    first = df.where("product_id = 'L-01'").first()
    assert first.review_content == 'says "good",\nthen more' and first.extra == "x"


def test_missing_file_and_column(spark, tmp_path, sample_rows):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_listings_csv(spark, str(tmp_path / "none.csv"))
    path = str(tmp_path / "short.csv")
    pd.DataFrame(sample_rows).drop(columns="rating").to_csv(path, index=False)
    with pytest.raises(KeyError, match="rating"):
        read_listings_csv(spark, path)


def test_feature_order(spark, csv):
    df = clean_listings(read_listings_csv(spark, csv))
    assert feature_target(df, "discount").columns == [*DISCOUNT_FEATURES, "discount_percentage"]
    assert feature_target(df, "price").columns == [*PRICE_FEATURES, "discounted_price"]
    assert DISCOUNT_FEATURES == ["actual_price", "discounted_price", "rating", "rating_count"]
    assert PRICE_FEATURES == ["actual_price", "rating", "rating_count", "discount_percentage"]
    assert feature_target(df, "price").count() == 3


def test_texts_are_parsed_once(spark, sample_rows):
    """The null check must read parsed columns, not repeat the parsing."""
    names = list(sample_rows)
    raw = spark.createDataFrame(list(zip(*sample_rows.values())), ", ".join(f"{n} string" for n in names))
    raw = raw.repartition(2)
    plan = clean_listings(raw).select(*NUMERIC)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_infinite_price_is_kept_and_nan_dropped(spark, sample_rows):
    rows = {**sample_rows, "actual_price": ["inf", "NaN", "₹5"]}
    raw = spark.createDataFrame(list(zip(*rows.values())), ", ".join(f"{n} string" for n in rows))
    got = clean_listings(raw).orderBy("product_id").select("product_id", "actual_price").collect()
    assert [tuple(r) for r in got] == [("L-01", math.inf), ("L-03", 5.0)]
    assert clean_listings(raw).where(F.col("category") == "none").count() == 0


def test_lines_are_dealt_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    """The only shuffles are those of the join: a line as numbers, a part once; no listing is shuffled."""
    from pyspark.sql.classic.dataframe import DataFrame

    from priceloom.plans import listing

    spark.range(400).selectExpr(
        "id as l_orderkey", "id % 20 as l_partkey", "id % 7 as l_suppkey", "cast(1 as int) as l_linenumber", "10D as l_quantity",
        "100D + id as l_extendedprice", "0.05D as l_discount").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "'b' as p_brand", "'t' as p_type").write.parquet(
        f"{tmp_path}/part.parquet")
    plan = listing.raw_listings(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2
    dealt = []
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, name=name, **b: dealt.append(name) or self)
    found = listing.listings(spark, str(tmp_path))
    assert dealt == []
    # Orders that 97, 101 or 89 divide lack a category, a discount or a rating; the last two are dropped.
    assert found.count() == 400 - len({i for i in range(400) if i % 101 == 0 or i % 89 == 0})
