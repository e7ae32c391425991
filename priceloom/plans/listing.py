"""The driver tables as listings: one listing per order line, joined to its part."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.operators.clean import clean_listings
from priceloom.session import ensure_checkpoint_dir
from priceloom.sources.listings import read_listings, write_listings


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listing text with planted nulls and junk, so that cleaning has work to do."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part")
    # The join deals the lines while they are a few numbers each, so no later step shuffles the texts.
    return lines.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) "
        "as product_id",
        "p_name as product_name",
        "if(l_orderkey % 97 = 0, null, concat_ws('|', p_type, p_brand, p_name)) as category",
        "concat('₹', format_number(floor(l_extendedprice * (1 - l_discount * 8)), 0)) as discounted_price",
        "concat('₹', format_number(l_extendedprice, 2)) as actual_price",
        "if(l_orderkey % 101 = 0, null, concat(cast(round(l_discount * 800) as int), '%')) as discount_percentage",
        "if(l_orderkey % 89 = 0, '|', cast((10 + cast(l_quantity as int) % 41) / 10.0D as string)) as rating",
        "format_number((l_suppkey * 7919 + l_partkey * 31) % 426900, 0) as rating_count",
        "concat_ws(' ', p_name, p_brand) as about_product",
        "concat_ws(' ', p_type, p_name) as review_content",
    )


_CLEAN: dict[tuple[str, str], str] = {}


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """The clean listings, written as Parquet once per application and folder and read from there.

    The join with the parts deals them, so that later scans have work for every core.
    """
    place = (spark.sparkContext.applicationId, folder)
    if place not in _CLEAN:
        path = f"{ensure_checkpoint_dir(spark)}/listings-{uuid.uuid4()}"
        write_listings(clean_listings(raw_listings(spark, folder)), path)
        _CLEAN[place] = path
    return read_listings(spark, _CLEAN[place])


# The same tables for the SQL check, written independently of the expressions above.
RAW_SQL = """
listings_raw as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   cast(round(l_extendedprice * 100) as bigint)) as product_id,
         p_name as product_name,
         case when l_orderkey % 97 = 0 then null else concat_ws('|', p_type, p_brand, p_name) end as category,
         concat('₹', format('{:,}', cast(floor(l_extendedprice * (1 - l_discount * 8)) as bigint))) as discounted_price,
         concat('₹', format('{:,.2f}', l_extendedprice)) as actual_price,
         case when l_orderkey % 101 = 0 then null
              else concat(cast(cast(round(l_discount * 800) as int) as varchar), '%') end as discount_percentage,
         case when l_orderkey % 89 = 0 then '|'
              else cast((10 + cast(l_quantity as int) % 41) / 10.0::double as varchar) end as rating,
         format('{:,}', (l_suppkey * 7919 + l_partkey * 31) % 426900) as rating_count,
         concat(p_name, ' ', p_brand) as about_product,
         concat(p_type, ' ', p_name) as review_content
  from lineitem join part on l_partkey = p_partkey
)"""

PARSED_SQL = RAW_SQL + r""",
listings_parsed as (
  select product_id, product_name, category,
         try_cast(trim(replace(replace(discounted_price, '₹', ''), ',', '')) as double) as discounted_price,
         try_cast(trim(replace(replace(actual_price, '₹', ''), ',', '')) as double) as actual_price,
         try_cast(regexp_replace(discount_percentage, '[^0-9.]', '', 'g') as double) as discount_percentage,
         try_cast(regexp_replace(rating, '[^0-9.]', '', 'g') as double) as rating,
         try_cast(regexp_replace(rating_count, '[^0-9.]', '', 'g') as double) as rating_count,
         about_product, review_content
  from listings_raw
)"""

LISTINGS_SQL = PARSED_SQL + """,
listings as (
  select *, split_part(coalesce(category, 'Unknown'), '|', 1) as top_category
  from listings_parsed
  where actual_price is not null and discounted_price is not null and discount_percentage is not null
    and rating is not null and rating_count is not null
)"""


def with_raw(body: str) -> str:
    return f"with {RAW_SQL}\n{body}"


def with_parsed(body: str) -> str:
    return f"with {PARSED_SQL}\n{body}"


def with_listings(body: str, ctes: str = "") -> str:
    more = f",\n{ctes}" if ctes else ""
    return f"with {LISTINGS_SQL}{more}\n{body}"
