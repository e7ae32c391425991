"""Sources, cleaning, projections and row-level expressions over the listings."""

import uuid

from pyspark.sql import functions as F

from priceloom.functions.cleaning import digits_to_double, price_to_double
from priceloom.functions.scalars import clamp_percent, formula_price, implied_discount, not_discounted
from priceloom.functions.text import answer_only, listing_document
from priceloom.operators.clean import clean_listings, feature_target, rejected_counts, with_top_category
from priceloom.operators.metrics import with_residual
from priceloom.operators.ordinal import with_ordinal
from priceloom.operators.quantile import clip_upper
from priceloom.operators.retrieval import bucket_vectors, hashed_vectors
from priceloom.operators.summary import points_below_cap, sample_products, training_stats
from priceloom.operators.training import fit_model, score
from priceloom.plans.listing import listings, raw_listings, table, with_listings, with_parsed
from priceloom.plans.registry import q, query, r, rounded, shown
from priceloom.schema import (
    DISCOUNT_FEATURES,
    INPUT_BOUNDS,
    PRICE_FEATURES,
    PRICE_TARGET,
    RAW_COLUMNS,
)
from priceloom.session import ensure_checkpoint_dir
from priceloom.sources.listings import read_listings, read_listings_csv, write_listings
from priceloom.sources.models import load_model, load_published, publish_model, save_model
from priceloom.sources.stats import add_batch, display_stats, merged_stats, read_stats, write_stats
from priceloom.sources.vectors import read_vectors, write_vectors
from priceloom.streaming.scoring import within_bounds

CLEAN_SQL = with_listings("select * exclude (top_category) from listings")


def scratch(spark, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def raw_csv(spark, folder, change=None) -> str:
    """The uncleaned listings as CSV files with all columns of the source; returns their folder."""
    raw = raw_listings(spark, folder)
    path = scratch(spark, "csv")
    full = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS])
    (change(full) if change else full).write.option("header", True).option("escape", '"').csv(path)
    return path


@query("a1_csv_scan", CLEAN_SQL)
def a1_csv_scan(spark, folder):
    cleaned = clean_listings(read_listings_csv(spark, raw_csv(spark, folder)))
    return cleaned.select(*raw_listings(spark, folder).columns)


@query("a1_csv_ranges", CLEAN_SQL)
def a1_csv_ranges(spark, folder):
    """Every record runs over several lines, and records are cut by byte ranges."""
    path = raw_csv(spark, folder, lambda df: df.withColumn("about_product", F.replace("about_product", F.lit(" "), F.lit("\n"))))
    read = read_listings_csv(spark, path, ranges=True)
    read = read.withColumn("about_product", F.replace("about_product", F.lit("\n"), F.lit(" ")))
    return clean_listings(read).select(*raw_listings(spark, folder).columns)


@query("a1_clean_parquet_scan", CLEAN_SQL)
def a1_clean_parquet_scan(spark, folder):
    path = scratch(spark, "listings")
    write_listings(listings(spark, folder), path)
    return read_listings(spark, path)


_STATS_ROWS = " union all ".join(
    f"select '{c}' as feature, {q(f'avg({c})')} as mean, {q(f'stddev_samp({c})')} as std from listings"
    for c in DISCOUNT_FEATURES
)


@query("a2_training_stats_sink", with_listings(_STATS_ROWS))
def a2_training_stats_sink(spark, folder):
    path = scratch(spark, "stats")
    write_stats(training_stats(listings(spark, folder), DISCOUNT_FEATURES), path, "parquet")
    return rounded(read_stats(spark, path, "parquet"))


@query("a3_training_stats_source", with_listings(
    f'select feature, mean as "Mean", std as "Std Dev" from ({_STATS_ROWS})'))
def a3_training_stats_source(spark, folder):
    path = scratch(spark, "stats")
    write_stats(training_stats(listings(spark, folder), DISCOUNT_FEATURES), path)
    return rounded(display_stats(read_stats(spark, path)))


@query("a2_a3_merged_stats", with_listings(_STATS_ROWS))
def a2_a3_merged_stats(spark, folder):
    """Statistics merged from three batches, one of which comes twice."""
    path = scratch(spark, "state")
    part = F.pmod(F.col("rating_count").cast("bigint"), F.lit(3))
    for batch in (0, 1, 2, 1):
        add_batch(listings(spark, folder).where(part == batch), DISCOUNT_FEATURES, path, batch)
    return rounded(merged_stats(spark, path))


_SAME_SCORES = with_listings("select count(*) as scored, cast(0 as double) as largest_gap from listings")


@query("a4_a5_published_model", _SAME_SCORES)
def a4_a5_published_model(spark, folder):
    """The model published last answers, not the one before it."""
    data = listings(spark, folder)
    path = scratch(spark, "models")
    part = data.where(F.pmod(F.col("rating_count").cast("bigint"), F.lit(2)) == 0)
    publish_model(spark, fit_model(part, "Linear Regression", PRICE_FEATURES, PRICE_TARGET), path, "line")
    model = fit_model(data, "Linear Regression", PRICE_FEATURES, PRICE_TARGET)
    publish_model(spark, model, path, "line")
    first = score(model, data).withColumnRenamed("prediction", "first")
    both = score(load_published(spark, path, "line")[0], first)
    gap = F.max(F.abs(F.col("first") - F.col("prediction")))
    return both.agg(F.count("*").alias("scored"), r(gap).alias("largest_gap"))


@query("a4_a5_model_round_trip", _SAME_SCORES)
def a4_a5_model_round_trip(spark, folder):
    data = listings(spark, folder)
    model = fit_model(data, "Linear Regression", PRICE_FEATURES, PRICE_TARGET)
    path = scratch(spark, "models")
    save_model(model, path, "line")
    first = score(model, data).withColumnRenamed("prediction", "first")
    both = score(load_model(path, "line"), first)
    gap = F.max(F.abs(F.col("first") - F.col("prediction")))
    return both.agg(F.count("*").alias("scored"), r(gap).alias("largest_gap"))


_ENCODED_SQL = f"""
select doc_id, length(text) as characters, 384 as dimension,
       cast(case when regexp_matches(text, '[^\\t-\\r ]') then 1 else 0 end as double) as squared_length
from documents"""


def _vector_facts(df, text):
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.select("doc_id", F.length(text).cast("bigint").alias("characters"),
                     F.size("embedding").alias("dimension"), r(squares, 4).alias("squared_length"))


@query("a6_a7_vector_table", _ENCODED_SQL)
def a6_a7_vector_table(spark, folder):
    path = scratch(spark, "vectors")
    documents = table(spark, folder, "documents")
    write_vectors(hashed_vectors(documents.withColumnRenamed("text", "document"), "document"), path)
    return _vector_facts(read_vectors(spark, path), "document")


@query("g1_hashed_vectors", _ENCODED_SQL)
def g1_hashed_vectors(spark, folder):
    documents = table(spark, folder, "documents")
    return _vector_facts(hashed_vectors(documents, "text"), "text")


_WEIGHTS_SQL = r"""
with words as (select doc_id, unnest(regexp_split_to_array(lower(text), '[\t-\r ]+')) as word from documents),
buckets as (select doc_id, ('0x' || substring(md5(word), 1, 8))::bigint % 384 as bucket, count(*) as n
            from words where word <> '' group by all)
select doc_id, bucket, """ + q("cast(cast(n / sqrt(sum(n * n) over (partition by doc_id)) as float) as double)", 5) \
    + " as weight from buckets"


def _weights(df):
    cells = df.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return rounded(cells.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"),
                                F.col("weight").cast("double").alias("weight")), 5)


@query("g1_bucket_vectors", _WEIGHTS_SQL)
def g1_bucket_vectors(spark, folder):
    return _weights(bucket_vectors(table(spark, folder, "documents"), "text"))


@query("a6_a7_vector_values", _WEIGHTS_SQL)
def a6_a7_vector_values(spark, folder):
    path = scratch(spark, "vectors")
    documents = table(spark, folder, "documents").withColumnRenamed("text", "document")
    write_vectors(bucket_vectors(documents, "document"), path)
    return _weights(read_vectors(spark, path))


@query("b1_clean_price", with_parsed("select product_id, actual_price, discounted_price from listings_parsed"))
def b1_clean_price(spark, folder):
    return raw_listings(spark, folder).select(
        "product_id", *[price_to_double(c).alias(c) for c in ("actual_price", "discounted_price")])


@query("b2_clean_numeric", with_parsed(
    "select product_id, rating, rating_count, discount_percentage from listings_parsed"))
def b2_clean_numeric(spark, folder):
    return raw_listings(spark, folder).select(
        "product_id", *[digits_to_double(c).alias(c) for c in ("rating", "rating_count", "discount_percentage")])


@query("b3_drop_incomplete", with_parsed("""
select count(*) as rows_read,
       count(*) filter (actual_price is null or discounted_price is null or discount_percentage is null
                        or rating is null or rating_count is null) as rows_dropped,
       count(*) filter (actual_price is null) as bad_actual_price,
       count(*) filter (discounted_price is null) as bad_discounted_price,
       count(*) filter (discount_percentage is null) as bad_discount_percentage,
       count(*) filter (rating is null) as bad_rating,
       count(*) filter (rating_count is null) as bad_rating_count
from listings_parsed"""))
def b3_drop_incomplete(spark, folder):
    return rejected_counts(raw_listings(spark, folder))


@query("b4_row_id", with_listings(
    "select product_id, row_number() over (order by product_id) - 1 as row_id from listings"))
def b4_row_id(spark, folder):
    return with_ordinal(listings(spark, folder).select("product_id"), ["product_id"])


@query("b5_clean_listings", CLEAN_SQL)
def b5_clean_listings(spark, folder):
    return listings(spark, folder)


@query("b6_discount_features", with_listings(
    "select product_id, actual_price, discounted_price, rating, rating_count, discount_percentage from listings"))
def b6_discount_features(spark, folder):
    return feature_target(listings(spark, folder), "discount", keep=("product_id",))


@query("b7_price_features", with_listings(
    "select product_id, actual_price, rating, rating_count, discount_percentage, discounted_price from listings"))
def b7_price_features(spark, folder):
    return feature_target(listings(spark, folder), "price", keep=("product_id",))


@query("b8_top_category", with_listings("select product_id, top_category from listings"))
def b8_top_category(spark, folder):
    return with_top_category(listings(spark, folder)).select("product_id", "top_category")


@query("b9_sample_products", with_listings("""
select product_name, discounted_price as "price (₹)", actual_price as "MRP (₹)",
       discount_percentage as "discount %", rating, rating_count
from listings order by product_id limit 30"""))
def b9_sample_products(spark, folder):
    return sample_products(listings(spark, folder))


@query("b10_implied_discount", with_listings(f"""
select product_id, {q('implied')} as implied, {q('discount_percentage - implied')} as delta
from (select *, case when actual_price > 0 then (1 - discounted_price / actual_price) * 100 else 0.0 end as implied
      from listings)"""))
def b10_implied_discount(spark, folder):
    df = listings(spark, folder).withColumn("implied", implied_discount(F.col("actual_price"), F.col("discounted_price")))
    return rounded(df.select("product_id", "implied", (F.col("discount_percentage") - F.col("implied")).alias("delta")))


def with_formula(df):
    return df.withColumn("formula", formula_price(F.col("actual_price"), F.col("discount_percentage")))


FORMULA_CTE = "formulas as (select *, actual_price * (1 - discount_percentage / 100) as formula from listings)"


@query("b11_formula_price", with_listings(
    f"select product_id, {q('formula')} as formula, {q('discounted_price - formula')} as delta from formulas", FORMULA_CTE))
def b11_formula_price(spark, folder):
    df = with_residual(with_formula(listings(spark, folder)), "discounted_price", "formula", "delta")
    return rounded(df.select("product_id", "formula", "delta"))


@query("b12_clamp_percent", with_listings(f"""
select product_id, {q('least(greatest(discount_percentage * 2 - 40 + rating, 0.0), 100.0)')} as clamped from listings"""))
def b12_clamp_percent(spark, folder):
    guess = F.col("discount_percentage") * 2 - 40 + F.col("rating")
    return rounded(listings(spark, folder).select("product_id", clamp_percent(guess).alias("clamped")))


@query("b13_not_discounted", with_listings(
    "select product_id, discounted_price >= actual_price as flagged from listings"))
def b13_not_discounted(spark, folder):
    flag = not_discounted(F.col("actual_price"), F.col("discounted_price"))
    return listings(spark, folder).select("product_id", flag.alias("flagged"))


@query("b17_documents", with_listings("""
select product_id as doc_id,
       'Product: ' || product_name || '. Category: ' || substring(coalesce(category, 'nan'), 1, 120)
       || '. Price: ₹' || format('{:.0f}', discounted_price) || ' (was ₹' || format('{:.0f}', actual_price)
       || ', ' || format('{:.0f}', discount_percentage) || '% off). Rating: ' || cast(rating as varchar)
       || '/5 from ' || format('{:.0f}', rating_count) || ' reviews. About: '
       || substring(coalesce(about_product, 'nan'), 1, 200) || '. Review: '
       || substring(coalesce(review_content, 'nan'), 1, 200) || '.' as document
from listings"""))
def b17_documents(spark, folder):
    return listings(spark, folder).select(F.col("product_id").alias("doc_id"), listing_document().alias("document"))


@query("b19_answers", r"""
select conv_id, turn,
       case when contains(generated, 'Answer:')
            then regexp_replace(string_split(generated, 'Answer:')[-1], '^\s+|\s+$', '', 'g')
            else generated end as answer
from (select conv_id, turn, case when turn % 2 = 1 then concat('Question: Answer: ', role, e'\n\nAnswer: \n', text, e' \t\n')
                                 else text end as generated
      from conversations)""")
def b19_answers(spark, folder):
    echoed = F.concat(F.lit("Question: Answer: "), F.col("role"), F.lit("\n\nAnswer: \n"), F.col("text"), F.lit(" \t\n"))
    generated = F.when(F.col("turn") % 2 == 1, echoed).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", answer_only(generated).alias("answer"))


@query("b20_round_and_echo", with_listings(f"""
select product_id, {shown('formula', 2)} as predicted, actual_price, rating, rating_count, discount_percentage
from formulas""", FORMULA_CTE))
def b20_round_and_echo(spark, folder):
    df = with_formula(listings(spark, folder)).withColumn("inputs", F.struct(*PRICE_FEATURES))
    return df.select("product_id", F.round("formula", 2).alias("predicted"), "inputs.*")


@query("b21_scatter_points", with_listings(f"""
select product_id, {q('least(actual_price, (select quantile_cont(actual_price, 0.95) from listings))')} as actual_price,
       discount_percentage, rating
from listings"""))
def b21_scatter_points(spark, folder):
    clipped = clip_upper(listings(spark, folder), "actual_price", 0.95)
    return rounded(clipped.select("product_id", "actual_price", "discount_percentage", "rating"))


@query("b22_points_below_cap", with_listings(f"""
select product_id, discounted_price as actual, {q('formula')} as predicted
from formulas, (select quantile_cont(discounted_price, 0.97) as cap from listings)
where discounted_price <= cap and formula <= cap""", FORMULA_CTE))
def b22_points_below_cap(spark, folder):
    df = with_formula(listings(spark, folder)).select(
        "product_id", F.col("discounted_price").alias("actual"), F.col("formula").alias("predicted"))
    return rounded(points_below_cap(df, "actual", "predicted"))


@query("b23_inputs_in_bounds", with_listings(
    "select product_id from listings where " + " and ".join(
        f"{c} between {low} and {high}" for c, (low, high) in INPUT_BOUNDS["discount"].items())))
def b23_inputs_in_bounds(spark, folder):
    return within_bounds(listings(spark, folder)).select("product_id")
