"""Encoding, scaling, aggregates, distributions and correlations over the listings."""

from itertools import combinations_with_replacement

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from priceloom.operators.clean import with_top_category
from priceloom.operators.correlation import (
    category_cross_correlation,
    correlation_matrix,
    encoded_correlation_matrix,
    extreme_links,
    extreme_sentence,
    insight_sentences,
    labelled,
    pair_sentences,
    strongest_pairs,
    target_correlations,
)
from priceloom.operators.encode import encode_category, one_hot_vector
from priceloom.operators.histogram import histogram
from priceloom.operators.metrics import evaluate, with_residual
from priceloom.operators.quantile import clip_between, clip_upper, exact_quantiles
from priceloom.operators.scale import normalize_features
from priceloom.operators.split import in_test
from priceloom.operators.summary import (
    axis_range,
    category_summary,
    describe_features,
    distribution_histograms,
    distribution_summary,
    feature_ranges,
    kpis,
    melt,
    percentile_rank,
    training_stats,
)
from priceloom.plans.cleaning import FORMULA_CTE, with_formula
from priceloom.plans.listing import listings, with_listings
from priceloom.plans.registry import q, query, rounded
from priceloom.schema import FEATURE_CONTEXT, FEATURE_LABELS, NUMERIC, PRICE_FEATURES

# ── Encoding and scaling ────────────────────────────────────────────────────


@query("c1_label_encoding", with_listings("""
select product_id, cast(dense_rank() over (order by top_category) - 1 as double) as category_label from listings"""))
def c1_label_encoding(spark, folder):
    encoded, names = encode_category(listings(spark, folder), "label")
    return encoded.select("product_id", *names)


@query("c2_frequency_encoding", with_listings(f"""
select product_id, {q('count(*) over (partition by top_category) / (count(*) over ())', 9)} as category_freq
from listings"""))
def c2_frequency_encoding(spark, folder):
    encoded, names = encode_category(listings(spark, folder), "frequency")
    return rounded(encoded.select("product_id", *names), 9)


def _target_sql(column):
    return with_listings(f"""
select product_id, {q('m')} as category_target
from listings join (select top_category, avg({column}) as m from listings group by all) using (top_category)""")


@query("c3_target_encoding_discount", _target_sql("discount_percentage"))
def c3_target_encoding_discount(spark, folder):
    encoded, names = encode_category(listings(spark, folder), "target")
    return rounded(encoded.select("product_id", *names))


@query("c3_target_encoding_price", _target_sql("discounted_price"))
def c3_target_encoding_price(spark, folder):
    encoded, names = encode_category(listings(spark, folder), "target", "discounted_price")
    return rounded(encoded.select("product_id", *names))


IS_TEST_SQL = "(('0x' || substring(md5(product_id), 1, 8))::bigint < 0.2 * 4294967296)"


@query("c3_target_encoding_train", with_listings(f"""
select product_id, {q('coalesce(m, (select avg(discount_percentage) from train))')} as category_target
from listings left join (select top_category, avg(discount_percentage) as m from train group by all)
  using (top_category)""", f"train as (select * from listings where not {IS_TEST_SQL})"))
def c3_target_encoding_train(spark, folder):
    df = listings(spark, folder)
    encoded, names = encode_category(df, "target", fit_on=df.where(~in_test(F.col("product_id"))))
    return rounded(encoded.select("product_id", *names))


# The six part types of the driver tables, and the category of listings without one.
_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "Unknown"]


@query("c4_one_hot_encoding", with_listings("select product_id, " + ", ".join(
    f"cast(top_category = '{c}' as int)::double as \"cat_{c}\"" for c in _CATEGORIES) + " from listings"))
def c4_one_hot_encoding(spark, folder):
    encoded, names = encode_category(listings(spark, folder), "onehot")
    return encoded.select("product_id", *names)


@query("c4_one_hot_vector", with_listings("""
select product_id, dense_rank() over (order by top_category) - 1 as position, 1.0::double as value,
       (select count(distinct top_category) from listings) as size from listings"""))
def c4_one_hot_vector(spark, folder):
    """The sparse form, cell by cell."""
    encoded, (name,) = one_hot_vector(listings(spark, folder))
    cells = F.posexplode(vector_to_array(F.col(name))).alias("position", "value")
    cell = encoded.select("product_id", F.size(vector_to_array(F.col(name))).cast("long").alias("size"), cells)
    return cell.where("value <> 0").select("product_id", F.col("position").cast("long").alias("position"), "value", "size")


@query("c0_encoding_methods", with_listings(f"""
select product_id, cast(dense_rank() over (order by top_category) - 1 as double) as category_label,
       {q('count(*) over (partition by top_category) / (count(*) over ())')} as category_freq,
       {q('avg(discount_percentage) over (partition by top_category)')} as category_target, """ + ", ".join(
    f"cast(top_category = '{c}' as int)::double as \"cat_{c}\"" for c in _CATEGORIES) + " from listings"))
def c0_encoding_methods(spark, folder):
    """The four methods by name, one after the other."""
    df, names = listings(spark, folder), []
    for method in ("label", "frequency", "target", "onehot"):
        df, added = encode_category(df, method)
        names += added
    return rounded(df.select("product_id", *names))


@query("c5_min_max_scaling", with_listings("select product_id, " + ", ".join(
    q(f"coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0)", 9) + f" as {c}"
    for c in NUMERIC) + " from listings"))
def c5_min_max_scaling(spark, folder):
    return rounded(normalize_features(listings(spark, folder)).select("product_id", *NUMERIC), 9)


# ── Aggregates ──────────────────────────────────────────────────────────────


@query("d1_kpis", with_listings(f"""
select count(*) as products, count(distinct category) as categories, {q('avg(discount_percentage)')} as avg_discount,
       {q('avg(rating)')} as avg_rating, {q('quantile_cont(discounted_price, 0.5)')} as median_price
from listings"""))
def d1_kpis(spark, folder):
    return rounded(kpis(listings(spark, folder)))


# The probabilities that reports use.
_PROBS = [0.02, 0.5, 0.95, 0.97, 0.98]


@query("d2_quantiles", with_listings(" union all ".join(
    f"select {p}::double as prob, {q(f'quantile_cont(discounted_price, {p})')} as value from listings" for p in _PROBS)))
def d2_quantiles(spark, folder):
    return rounded(exact_quantiles(listings(spark, folder), "discounted_price", _PROBS))


@query("d2_quantiles_by_category", with_listings(" union all ".join(
    f"select top_category, {p}::double as prob, {q(f'quantile_cont(actual_price, {p})')} as value "
    "from listings group by all" for p in _PROBS)))
def d2_quantiles_by_category(spark, folder):
    df = with_top_category(listings(spark, folder))
    return rounded(exact_quantiles(df, "actual_price", _PROBS, ("top_category",)))


@query("d3_clip_upper", with_listings(f"""
select product_id, {q('least(discounted_price, (select quantile_cont(discounted_price, 0.97) from listings))')}
       as discounted_price
from listings"""))
def d3_clip_upper(spark, folder):
    return rounded(clip_upper(listings(spark, folder), "discounted_price", 0.97).select("product_id", "discounted_price"))


@query("d4_clip_between", with_listings(f"""
select product_id, {q('greatest(least(residual, high), low)')} as residual
from (select product_id, discounted_price - formula as residual from formulas),
     (select quantile_cont(discounted_price - formula, 0.02) as low,
             quantile_cont(discounted_price - formula, 0.98) as high from formulas)""", FORMULA_CTE))
def d4_clip_between(spark, folder):
    df = with_residual(with_formula(listings(spark, folder)), "discounted_price", "formula")
    return rounded(clip_between(df, "residual", 0.02, 0.98).select("product_id", "residual"))


_MELT_CTE = "long as (" + " union all ".join(
    f"select product_id, '{c}' as feature_name, {c} as v from listings" for c in NUMERIC) + ")"


@query("d5_clip_by_group", with_listings(f"""
select product_id, feature_name as "Feature", {q('least(v, cap)')} as "Value"
from long join (select feature_name, quantile_cont(v, 0.98) as cap from long group by all) using (feature_name)
""", _MELT_CTE))
def d5_clip_by_group(spark, folder):
    long = listings(spark, folder).unpivot(["product_id"], NUMERIC, "Feature", "Value")
    return rounded(clip_upper(long, "Value", 0.98, ("Feature",)))


def histogram_sql(source, column, bins, ctes=""):
    """Histogram of a column; a bin's edges decide, not a quotient."""
    text = f"""
edges as (
  select i as bin, case when i = 0 then lo else lo + i * ((hi - lo) / {bins}) end as bin_start,
         case when i = {bins - 1} then hi else lo + (i + 1) * ((hi - lo) / {bins}) end as bin_end
  from (select case when min({column}) = max({column}) then min({column}) - 0.5 else min({column}) end as lo,
               case when min({column}) = max({column}) then max({column}) + 0.5 else max({column}) end as hi
        from {source}), range({bins}) as numbers(i)
)"""
    body = f"""
select bin, {q('bin_start')} as bin_start, {q('bin_end')} as bin_end, count({column}) as count
from edges left join {source}
  on {column} >= bin_start and ({column} < bin_end or (bin = {bins - 1} and {column} <= bin_end))
group by bin, bin_start, bin_end"""
    return with_listings(body, f"{ctes},{text}" if ctes else text)


@query("d6_histogram_discount", histogram_sql("listings", "discount_percentage", 40))
def d6_histogram_discount(spark, folder):
    return rounded(histogram(listings(spark, folder), "discount_percentage", 40))


@query("d6_histogram_rating", histogram_sql("listings", "rating", 25))
def d6_histogram_rating(spark, folder):
    return rounded(histogram(listings(spark, folder), "rating", 25))


@query("d6_histogram_clipped_price", histogram_sql("clipped", "price", 40, """
clipped as (select least(discounted_price, (select quantile_cont(discounted_price, 0.97) from listings)) as price
            from listings)"""))
def d6_histogram_clipped_price(spark, folder):
    return rounded(histogram(listings(spark, folder), "discounted_price", 40, high=0.97))


@query("d7_mean_line", with_listings(f"select {q('avg(discount_percentage)')} as mean from listings"))
def d7_mean_line(spark, folder):
    return rounded(describe_features(listings(spark, folder), ["discount_percentage"]).select("mean"))


@query("d8_feature_ranges", with_listings(" union all ".join(
    f"select '{c}' as feature, {q(f'min({c})')} as min, {q(f'max({c})')} as max, {q(f'max({c}) - min({c})')} as range "
    "from listings" for c in NUMERIC)))
def d8_feature_ranges(spark, folder):
    return rounded(feature_ranges(listings(spark, folder)))


@query("d9_training_stats", with_listings(" union all ".join(
    f"select '{c}' as feature, {q(f'avg({c})')} as mean, {q(f'stddev_samp({c})')} as std from listings"
    for c in PRICE_FEATURES)))
def d9_training_stats(spark, folder):
    return rounded(training_stats(listings(spark, folder), PRICE_FEATURES))


def _describe_sql(source, columns, names):
    return " union all ".join(
        f"select '{n}' as feature, {q(f'min({c})')} as min, {q(f'max({c})')} as max, {q(f'avg({c})')} as mean, "
        f"{q(f'stddev_samp({c})')} as std from {source}" for c, n in zip(columns, names))


@query("d10_describe", with_listings(_describe_sql("listings", NUMERIC, NUMERIC)))
def d10_describe(spark, folder):
    return rounded(describe_features(listings(spark, folder)))


@query("d10_describe_scaled", with_listings(_describe_sql(
    "(select " + ", ".join(f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) as {c}" for c in NUMERIC)
    + " from listings)", NUMERIC, NUMERIC)))
def d10_describe_scaled(spark, folder):
    return rounded(describe_features(normalize_features(listings(spark, folder))))


_SUMMARY_SQL = f"""
select top_category, count(discount_percentage) as count, {q('avg(discount_percentage)')} as avg_discount,
       {q('avg(actual_price)')} as avg_actual_price, {q('avg(discounted_price)')} as avg_disc_price,
       {q('avg(rating)')} as avg_rating
from listings group by top_category order by """


@query("d11_category_summary", with_listings(_SUMMARY_SQL + "count desc, top_category"))
def d11_category_summary(spark, folder):
    return rounded(category_summary(listings(spark, folder)))


@query("d12_category_by_discount", with_listings(_SUMMARY_SQL + "avg_discount, top_category"))
def d12_category_by_discount(spark, folder):
    return rounded(category_summary(listings(spark, folder), "avg_discount"))


@query("d12_category_by_price", with_listings(_SUMMARY_SQL + "avg_disc_price, top_category"))
def d12_category_by_price(spark, folder):
    return rounded(category_summary(listings(spark, folder), "avg_disc_price"))


# ── Correlations ────────────────────────────────────────────────────────────


def matrix_cte(name, source, columns):
    """A CTE with one row per pair of columns; a constant column gives null."""
    cells = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        a, b = columns[i], columns[j]
        r = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
        for x, y in {(a, b), (b, a)}:
            cells.append(f"select '{x}' as row_feature, '{y}' as col_feature, {r} as r from {source}")
    return f"{name} as materialized (" + " union all ".join(cells) + ")"


MATRIX_CTE = matrix_cte("matrix", "listings", NUMERIC)
_MATRIX_ROWS = f"select row_feature, col_feature, {q('r', 9)} as r from matrix"


@query("d13_correlation_matrix", with_listings(_MATRIX_ROWS, MATRIX_CTE))
def d13_correlation_matrix(spark, folder):
    return rounded(correlation_matrix(listings(spark, folder)), 9)


def _encoded(spark, folder, method, target="discount_percentage"):
    return rounded(encoded_correlation_matrix(listings(spark, folder), method, target), 9)


def _encoded_sql(expression, name):
    return with_listings(_MATRIX_ROWS, f"coded as materialized (select *, {expression} as {name} from listings),\n"
                         + matrix_cte("matrix", "coded", [*NUMERIC, name]))


@query("d14_correlation_label", _encoded_sql("dense_rank() over (order by top_category) - 1", "category_label"))
def d14_correlation_label(spark, folder):
    return _encoded(spark, folder, "label")


@query("d14_correlation_frequency", _encoded_sql(
    "count(*) over (partition by top_category) / (count(*) over ())", "category_freq"))
def d14_correlation_frequency(spark, folder):
    return _encoded(spark, folder, "frequency")


@query("d14_correlation_target", _encoded_sql(
    "avg(discount_percentage) over (partition by top_category)", "category_target"))
def d14_correlation_target(spark, folder):
    return _encoded(spark, folder, "target")


@query("d14_correlation_target_price", _encoded_sql(
    "avg(discounted_price) over (partition by top_category)", "category_target"))
def d14_correlation_target_price(spark, folder):
    return _encoded(spark, folder, "target", "discounted_price")


@query("d15_category_cross_correlation", with_listings(" union all ".join(
    f"""select c.category, '{f}' as feature,
        {q(f"covar_pop(cast(top_category = c.category as int), {f}) / nullif(stddev_pop(cast(top_category = c.category as int)) * stddev_pop({f}), 0)", 9)} as r
        from listings, (select distinct top_category as category from listings) c group by c.category"""
    for f in NUMERIC)))
def d15_category_cross_correlation(spark, folder):
    return rounded(category_cross_correlation(listings(spark, folder)), 9)


def _against_sql(target):
    return with_listings(f"""
select row_feature as feature, {q('r', 9)} as r from matrix
where col_feature = '{target}' and row_feature <> '{target}' order by abs(r) desc nulls last, feature""", MATRIX_CTE)


@query("d16_target_correlations_discount", _against_sql("discount_percentage"))
def d16_target_correlations_discount(spark, folder):
    return rounded(target_correlations(correlation_matrix(listings(spark, folder))), 9)


@query("d16_target_correlations_price", _against_sql("discounted_price"))
def d16_target_correlations_price(spark, folder):
    return rounded(target_correlations(correlation_matrix(listings(spark, folder)), "discounted_price"), 9)


_LINKS_CTE = MATRIX_CTE + """,
links as (select row_feature as feature, r from matrix
          where col_feature = 'discount_percentage' and row_feature <> 'discount_percentage')"""


@query("d17_extreme_links", with_listings(f"""
select arg_max(feature, r) as positive_feature, {q('max(r)', 9)} as positive_r,
       arg_min(feature, r) as negative_feature, {q('min(r)', 9)} as negative_r from links""", _LINKS_CTE))
def d17_extreme_links(spark, folder):
    return rounded(extreme_links(correlation_matrix(listings(spark, folder))), 9)



def _pairs_sql(columns):
    place = "list_position([" + ", ".join(f"'{c}'" for c in columns) + "], {})"
    return f"""
select row_feature as first_feature, col_feature as second_feature, r from matrix
where row_feature <> 'discount_percentage' and col_feature <> 'discount_percentage'
  and {place.format('row_feature')} < {place.format('col_feature')}
order by abs(r) desc nulls last, first_feature desc, second_feature desc limit 3"""


_PAIRS = _pairs_sql(NUMERIC)


@query("d18_strongest_pairs", with_listings(
    f"select first_feature, second_feature, {q('r', 9)} as r, abs(r) > 0.7 as overlap from ({_PAIRS})", MATRIX_CTE))
def d18_strongest_pairs(spark, folder):
    return rounded(strongest_pairs(correlation_matrix(listings(spark, folder))), 9)


@query("d18_strongest_pairs_encoded", with_listings(
    f"select first_feature, second_feature, {q('r', 9)} as r, abs(r) > 0.7 as overlap "
    f"from ({_pairs_sql([*NUMERIC, 'category_target'])})",
    "coded as materialized (select *, avg(discount_percentage) over (partition by top_category) as category_target "
    f"from listings),\n{matrix_cte('matrix', 'coded', [*NUMERIC, 'category_target'])}"))
def d18_strongest_pairs_encoded(spark, folder):
    return rounded(strongest_pairs(encoded_correlation_matrix(listings(spark, folder), "target")), 9)


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _label_sql(column, labels, default=None):
    cases = " ".join(f"when '{k}' then {_quoted(v)}" for k, v in labels.items())
    return f"(case {column} {cases} else {default or column} end)"


@query("b14_insight_sentences", with_listings(f"""
select feature, {q('r', 9)} as r,
       '**' || label || '** is ' || case when abs(r) > 0.6 then 'strongly' when abs(r) > 0.3 then 'moderately' else 'weakly' end
       || case when r > 0 then ' positively' else ' negatively' end || ' correlated with discount (r = '
       || printf('%+.2f', r) || ') — higher ' || label || ' tends to mean a **'
       || case when r > 0 then 'higher' else 'lower' end || ' discount**. ' || context as sentence
from (select *, {_label_sql('feature', FEATURE_LABELS)} as label, {_label_sql('feature', FEATURE_CONTEXT, "''")} as context
      from links)""", _LINKS_CTE))
def b14_insight_sentences(spark, folder):
    return rounded(insight_sentences(correlation_matrix(listings(spark, folder))), 9)


@query("b15_pair_sentences", with_listings(f"""
select first_feature, second_feature, {q('r', 9)} as r, abs(r) > 0.7 as overlap,
       case when abs(r) > 0.7
            then '⚠️ **' || a || '** and **' || b || '** are highly correlated (r = ' || printf('%+.2f', r)
                 || '). They carry overlapping information — but both contribute to computing the price ratio, so both are kept.'
            else '**' || a || '** and **' || b || '**: r = ' || printf('%+.2f', r) || '.' end as sentence
from (select *, {_label_sql('first_feature', FEATURE_LABELS)} as a, {_label_sql('second_feature', FEATURE_LABELS)} as b
      from ({_PAIRS}))""", MATRIX_CTE))
def b15_pair_sentences(spark, folder):
    return rounded(pair_sentences(correlation_matrix(listings(spark, folder))), 9)


@query("b16_extreme_sentence", with_listings(f"""
select {_label_sql('up', FEATURE_LABELS)} as positive_label, {q('up_r', 9)} as positive_r,
       case when down_r < -0.1
            then 'The most negative is **' || label || '** (r = ' || printf('%+.2f', down_r) || ') — higher '
                 || lower(label) || ' → smaller discount.'
            else 'No strong negative relationships exist in this view — all features correlate positively or near-zero with discount %.'
       end as negative_sentence
from (select *, {_label_sql('down', FEATURE_LABELS)} as label
      from (select arg_max(feature, r) as up, max(r) as up_r, arg_min(feature, r) as down, min(r) as down_r from links))
""", _LINKS_CTE))
def b16_extreme_sentence(spark, folder):
    return rounded(extreme_sentence(correlation_matrix(listings(spark, folder))), 9)


@query("b24_labelled_matrix", with_listings(f"""
select {_label_sql('row_feature', FEATURE_LABELS)} as row_feature, {_label_sql('col_feature', FEATURE_LABELS)} as col_feature,
       {q('r', 9)} as r from matrix""",
    f"coded as materialized (select *, avg(discount_percentage) over (partition by top_category) as category_target "
    f"from listings),\n{matrix_cte('matrix', 'coded', [*NUMERIC, 'category_target'])}"))
def b24_labelled_matrix(spark, folder):
    return rounded(labelled(encoded_correlation_matrix(listings(spark, folder), "target")), 9)


# ── Ranks, long form, distributions, prediction quality ─────────────────────


@query("d19_percentile_rank", with_listings(f"""
select value, {q('100.0 * count(*) filter (discount_percentage <= value) / count(*)')} as percent
from listings, (select distinct floor(avg(discount_percentage)) as value from listings group by category)
group by value"""))
def d19_percentile_rank(spark, folder):
    df = listings(spark, folder)
    asked = df.groupBy("category").agg(F.floor(F.avg("discount_percentage")).cast("double").alias("value"))
    return rounded(percentile_rank(df, "discount_percentage", asked))


@query("d20_unpivot", with_listings('select feature_name as "Feature", v as "Value" from long', _MELT_CTE))
def d20_unpivot(spark, folder):
    return melt(listings(spark, folder))


@query("d21_distribution_summary", with_listings(f"""
select feature_name as "Feature", {q('min(least(v, cap))')} as raw_min, {q('quantile_cont(least(v, cap), 0.25)')} as raw_q25,
       {q('quantile_cont(least(v, cap), 0.5)')} as raw_median, {q('quantile_cont(least(v, cap), 0.75)')} as raw_q75,
       {q('max(least(v, cap))')} as raw_max, {q('quantile_cont(scaled, 0.25)')} as scaled_q25,
       {q('quantile_cont(scaled, 0.5)')} as scaled_q50, {q('quantile_cont(scaled, 0.75)')} as scaled_q75
from (select feature_name, v, cap, (v - low) / (high - low) as scaled
      from long join (select feature_name, quantile_cont(v, 0.98) as cap, min(v) as low, max(v) as high
                      from long group by all) using (feature_name))
group by all""", _MELT_CTE))
def d21_distribution_summary(spark, folder):
    return rounded(distribution_summary(listings(spark, folder)))


@query("d21_distribution_histograms", with_listings(f"""
select edges.feature_name as "Feature", bin, {q('bin_start')} as bin_start, {q('bin_end')} as bin_end, count(v) as count
from edges left join clipped
  on edges.feature_name = clipped.feature_name and v >= bin_start and (v < bin_end or (bin = 39 and v <= bin_end))
group by edges.feature_name, bin, bin_start, bin_end""", _MELT_CTE + """,
clipped as materialized (
  select feature_name, least(v, cap) as v
  from long join (select feature_name, quantile_cont(v, 0.98) as cap from long group by all) using (feature_name)),
edges as materialized (
  select feature_name, i as bin, case when i = 0 then lo else lo + i * ((hi - lo) / 40) end as bin_start,
         case when i = 39 then hi else lo + (i + 1) * ((hi - lo) / 40) end as bin_end
  from (select feature_name, min(v) as lo, max(v) as hi from clipped group by all), range(40) as numbers(i))"""))
def d21_distribution_histograms(spark, folder):
    return rounded(distribution_histograms(listings(spark, folder)))


_QUALITY_SQL = f"""
select {q('sqrt(avg((y - p) * (y - p)))')} as rmse, {q('avg(abs(y - p))')} as mae,
       {q('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))', 9)} as r2"""


@query("d22_regression_metrics", with_listings(
    _QUALITY_SQL + " from (select discounted_price as y, formula as p from formulas)", FORMULA_CTE))
def d22_regression_metrics(spark, folder):
    quality = evaluate(with_formula(listings(spark, folder)), "discounted_price", "formula")
    return quality.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 9).alias("r2"))


_RESIDUAL_CTE = FORMULA_CTE + ", residuals as (select round(discounted_price - formula, 6) as residual from formulas)"


def _residuals(spark, folder):
    df = with_residual(with_formula(listings(spark, folder)), "discounted_price", "formula")
    return df.withColumn("residual", F.round("residual", 6))


@query("d23_residual_histogram", histogram_sql("residuals", "residual", 40, _RESIDUAL_CTE))
def d23_residual_histogram(spark, folder):
    return rounded(histogram(_residuals(spark, folder), "residual", 40))


@query("d23_clipped_residual_histogram", histogram_sql("clipped", "residual", 40, _RESIDUAL_CTE + """,
clipped as (select greatest(least(residual, (select quantile_cont(residual, 0.98) from residuals)),
                            (select quantile_cont(residual, 0.02) from residuals)) as residual from residuals)"""))
def d23_clipped_residual_histogram(spark, folder):
    return rounded(histogram(_residuals(spark, folder), "residual", 40, 0.02, 0.98))


@query("d24_axis_range", with_listings(f"""
select {q('least(min(discounted_price), min(formula))')} as axis_min,
       {q('greatest(max(discounted_price), max(formula))')} as axis_max from formulas""", FORMULA_CTE))
def d24_axis_range(spark, folder):
    return rounded(axis_range(with_formula(listings(spark, folder)), "discounted_price", "formula"))
