"""Drift, scoring in batch and as a stream, retrieval and prompts."""

from string import Formatter

from pyspark.sql import functions as F

from priceloom.functions.text import PROMPT
from priceloom.operators.drift import check_drift, drift_report, with_z_scores
from priceloom.operators.retrieval import bucket_vectors, nearest_documents, prompts, with_documents
from priceloom.operators.summary import training_stats
from priceloom.operators.training import fit_model
from priceloom.plans.cleaning import scratch
from priceloom.plans.linear_sql import moments_cte, solve_ctes
from priceloom.plans.listing import listings, table, with_listings
from priceloom.plans.registry import q, query, rounded, shown
from priceloom.plans.workflows import question_prompts
from priceloom.schema import DISCOUNT_FEATURES, DISCOUNT_TARGET, PRICE_FEATURES, PRICE_TARGET
from priceloom.sources.models import publish_model
from priceloom.sources.stats import add_batch
from priceloom.sources.vectors import read_vectors, write_vectors
from priceloom.streaming.scoring import (
    discount_answers,
    price_answers,
    read_requests,
    score_published,
    score_stream,
    scored_with_drift,
)

# ── Drift: statistics and models from all listings, checked on requests with planted outliers ─

PLANTED = "if(pmod(cast(rating_count as bigint), 50) = 0, actual_price * 10, actual_price)"
_REQUESTS_SQL = """requests as (select product_id, case when cast(rating_count as bigint) % 50 = 0 then actual_price * 10
  else actual_price end as actual_price, discounted_price, rating, rating_count from listings)"""


def _stats(spark, folder):
    return training_stats(listings(spark, folder), DISCOUNT_FEATURES)


def _z_cte(name, source):
    """Requests with their z-scores by the statistics of ``source``."""
    z = ", ".join(f"{c}, case when s_{c} > 0 then abs(({c} - m_{c}) / s_{c}) else 0 end as z_{c}" for c in DISCOUNT_FEATURES)
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in DISCOUNT_FEATURES)
    return f"{name} as materialized (select product_id, {z} from requests, (select {stats} from {source}))"


_Z_CTE = _REQUESTS_SQL + ", " + _z_cte("z", "listings")
_ANY = " or ".join(f"z_{c} > 3" for c in DISCOUNT_FEATURES)


@query("f1_z_scores", with_listings(
    "select product_id, " + ", ".join(f"{q(f'z_{c}')} as z_{c}" for c in DISCOUNT_FEATURES) + " from z", _Z_CTE))
def f1_z_scores(spark, folder):
    scored = with_z_scores(_requests(spark, folder), _stats(spark, folder), DISCOUNT_FEATURES)
    return rounded(scored.select("product_id", *[f"z_{c}" for c in DISCOUNT_FEATURES]))


@query("f2_drift_flag", with_listings(f"select product_id, {_ANY} as drift_detected from z", _Z_CTE))
def f2_drift_flag(spark, folder):
    checked = check_drift(_requests(spark, folder), _stats(spark, folder), DISCOUNT_FEATURES)
    return checked.select("product_id", "drift_detected")


_LINE = (moments_cte("train_m", "listings", DISCOUNT_FEATURES, DISCOUNT_TARGET) + ",\n"
         + solve_ctes("line", "train_m", list(range(len(DISCOUNT_FEATURES)))) + ",\n" + _Z_CTE)
_PREDICTION = " + ".join(f"w{i} * {c}" for i, c in enumerate(DISCOUNT_FEATURES)) + " + w"
_ANSWERED = (f"select product_id, {shown(_PREDICTION, 2)} as predicted_discount_percentage, ({_ANY}) as drift_warning, "
             + ", ".join(f"{shown(f'z_{c}', 3)} as z_{c}, {c}" for c in DISCOUNT_FEATURES))
_SCORED_SQL = with_listings(f"{_ANSWERED} from z, line", _LINE)


def _flat(scored):
    z = [F.col("drift_details")[c].alias(f"z_{c}") for c in DISCOUNT_FEATURES]
    return scored.select("product_id", "predicted_discount_percentage", "drift_warning", *z, "inputs.*")


def _requests(spark, folder):
    return listings(spark, folder).withColumn("actual_price", F.expr(PLANTED)).select("product_id", *DISCOUNT_FEATURES)


def _line_model(spark, folder):
    return fit_model(listings(spark, folder), "Linear Regression", DISCOUNT_FEATURES, DISCOUNT_TARGET)


@query("f3_scoring_with_drift", _SCORED_SQL)
def f3_scoring_with_drift(spark, folder):
    return _flat(scored_with_drift(_requests(spark, folder), _line_model(spark, folder), _stats(spark, folder)))


@query("f3_scoring_without_stats", with_listings(
    f"select product_id, {shown(_PREDICTION, 2)} as predicted_discount_percentage, false as drift_warning, "
    "0 as details from z, line", _LINE))
def f3_scoring_without_stats(spark, folder):
    scored = scored_with_drift(_requests(spark, folder), _line_model(spark, folder))
    return scored.select("product_id", "predicted_discount_percentage", "drift_warning",
                         F.size("drift_details").alias("details"))


_CLAMPED = f"least(greatest({_PREDICTION}, 0.0), 100.0)"
_IMPLIED = "case when actual_price > 0 then (1 - discounted_price / actual_price) * 100 else 0.0 end"


@query("w2_discount_answers", with_listings(
    f"select product_id, {q(_CLAMPED, 4)} as predicted, {q(_IMPLIED, 4)} as implied, "
    f"{q(f'{_CLAMPED} - ({_IMPLIED})', 4)} as difference, ({_ANY}) as drift_detected from z, line", _LINE))
def w2_discount_answers(spark, folder):
    answers = discount_answers(_requests(spark, folder), _line_model(spark, folder), _stats(spark, folder))
    return rounded(answers.select("product_id", "predicted", "implied", "difference", "drift_detected"), 4)


_PRICE_LINE = (moments_cte("price_m", "listings", PRICE_FEATURES, PRICE_TARGET) + ",\n"
               + solve_ctes("line", "price_m", list(range(len(PRICE_FEATURES)))))
_PRICE = " + ".join(f"w{i} * {c}" for i, c in enumerate(PRICE_FEATURES)) + " + w"
_FORMULA = "actual_price * (1 - discount_percentage / 100)"


@query("w3_price_answers", with_listings(
    f"select product_id, {q(_PRICE, 4)} as predicted, {q(_FORMULA, 4)} as formula, "
    f"{q(f'{_PRICE} - {_FORMULA}', 4)} as difference, ({_PRICE}) >= actual_price as above_list from listings, line",
    _PRICE_LINE))
def w3_price_answers(spark, folder):
    df = listings(spark, folder)
    answers = price_answers(df, fit_model(df, "Linear Regression", PRICE_FEATURES, PRICE_TARGET))
    return rounded(answers.select("product_id", "predicted", "formula", "difference", "above_list"), 4)


@query("f4_drift_report", with_listings(" union all ".join(
    f"select '{c}' as feature, count(*) as checked, count(*) filter (z_{c} > 3) as flagged, {q(f'max(z_{c})')} as max_z from z"
    for c in DISCOUNT_FEATURES), _Z_CTE))
def f4_drift_report(spark, folder):
    return rounded(drift_report(_requests(spark, folder), _stats(spark, folder), DISCOUNT_FEATURES))


@query("s1_stream_scoring", _SCORED_SQL)
def s1_stream_scoring(spark, folder):
    """The requests arrive as files, are scored as a stream, and the written result is read back."""
    requests, out = scratch(spark, "requests"), scratch(spark, "scored")
    _requests(spark, folder).write.parquet(requests)
    stats = scratch(spark, "stats")
    _stats(spark, folder).coalesce(1).write.parquet(stats)
    batch = spark.read.parquet(requests)
    stream = read_requests(spark, requests, batch.schema)
    model = _line_model(spark, folder)
    score_stream(stream, model, spark.read.parquet(stats), out, available_now=True).awaitTermination()
    return _flat(spark.read.parquet(out))


_EVEN = "cast(rating_count as bigint) % 2 = 0"
_REFRESHED = ",\n".join([_REQUESTS_SQL, f"early as (select * from listings where {_EVEN})"] + [
    part for name, source in (("first", "early"), ("second", "listings")) for part in (
        moments_cte(f"m_{name}", source, DISCOUNT_FEATURES, DISCOUNT_TARGET),
        solve_ctes(f"line_{name}", f"m_{name}", list(range(len(DISCOUNT_FEATURES)))),
        _z_cte(f"z_{name}", source))])


@query("s1_refreshed_scoring", with_listings(
    f"{_ANSWERED} from z_first, line_first where {_EVEN} union all "
    f"{_ANSWERED} from z_second, line_second where not {_EVEN}", _REFRESHED))
def s1_refreshed_scoring(spark, folder):
    """A model and statistics that are replaced between two batches: each is scored with what was current."""
    rows, requests = listings(spark, folder), _requests(spark, folder)
    models, stats, inbox, out = (scratch(spark, name) for name in ("models", "state", "requests", "scored"))
    for name, arrived, known in (("first", _EVEN, rows.where(_EVEN)), ("second", f"not {_EVEN}", rows)):
        publish_model(spark, fit_model(known, "Linear Regression", DISCOUNT_FEATURES, DISCOUNT_TARGET), models, "line")
        add_batch(rows.where(arrived), DISCOUNT_FEATURES, stats, name)
        requests.where(arrived).write.mode("append").parquet(inbox)
        stream = read_requests(spark, inbox, requests.schema)
        score_published(stream, models, "line", stats, out, available_now=True).awaitTermination()
    return _flat(spark.read.parquet(out))


# ── Retrieval: every vector asks for its neighbours among all vectors ───────

_RANKED = """ranked as (
  select a.vec_id as query_id, b.vec_id as doc_id, a.label,
         pow(list_distance(a.embedding::double[], b.embedding::double[]), 2) as distance,
         row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank
  from embeddings a, embeddings b
)"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def prompt_sql(**values: str) -> str:
    """The prompt around SQL expressions."""
    parts = []
    for text, name, _, _ in Formatter().parse(PROMPT):
        parts += ["e'" + text.replace("'", "''").replace("\n", "\\n") + "'"] if text else []
        parts += [values[name]] if name else []
    return " || ".join(parts)


def _neighbours(spark, folder, k=3, **columns):
    vectors = _vectors(spark, folder)
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding", *[c.alias(n) for n, c in columns.items()])
    return nearest_documents(asked, corpus, k)


@query("g2_nearest_documents", f"""
with {_RANKED} select query_id, rank, doc_id, {q('distance', 5)} as distance from ranked where rank <= 3""")
def g2_nearest_documents(spark, folder):
    return rounded(_neighbours(spark, folder), 5)


@query("g3_neighbours_per_question", f"""
with {_RANKED} select query_id, rank, doc_id, {q('distance', 5)} as distance from ranked where rank <= 1 + label % 4""")
def g3_neighbours_per_question(spark, folder):
    return rounded(_neighbours(spark, folder, top_k=1 + F.col("label") % 4), 5)


@query("g3_repeated_question_ids", f"""
with {_RANKED} select label as query_id, rank, doc_id, {q('distance', 5)} as distance
from ranked where rank <= 1 + query_id % 3""")
def g3_repeated_question_ids(spark, folder):
    """All vectors of a label ask under the same id, with a different number of neighbours each."""
    vectors = _vectors(spark, folder)
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.select(F.col("label").alias("query_id"), "embedding", (1 + F.col("vec_id") % 3).alias("top_k"))
    return rounded(nearest_documents(asked, corpus), 5)


@query("g5_short_corpus", f"""
with parts as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, avg(x::double) as m from parts group by all),
centres as (select label as doc_id, list(m order by i) as centre from means group by all),
ranked as (select vec_id as query_id, doc_id, pow(list_distance(embedding::double[], centre), 2) as distance
           from embeddings, centres)
select query_id, row_number() over (partition by query_id order by distance, doc_id) as rank, doc_id,
       {q('distance', 5)} as distance from ranked""")
def g5_short_corpus(spark, folder):
    """More neighbours are asked for than the corpus, one mean vector per label, has rows."""
    vectors = _vectors(spark, folder)
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    centres = means.groupBy(F.col("label").alias("doc_id")).agg(F.transform(ordered, lambda p: p["m"]).alias("embedding"))
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(nearest_documents(asked, centres, 1000), 5)


@query("g4_neighbour_texts", f"""
with {_RANKED} select query_id, rank, text as document
from ranked join documents using (doc_id) where rank <= 3""")
def g4_neighbour_texts(spark, folder):
    found = with_documents(_neighbours(spark, folder), table(spark, folder, "documents"), text="text")
    return found.select("query_id", "rank", "document")


@query("b18_prompts", f"""
with {_RANKED}
select query_id, string_agg(d.text, e'\\n\\n' order by rank) as context,
       {prompt_sql(context="string_agg(d.text, e'\\n\\n' order by rank)", question="any_value(asked.text)")} as prompt
from ranked join documents d using (doc_id) join documents asked on asked.doc_id = query_id
where rank <= 3 group by query_id""")
def b18_prompts(spark, folder):
    documents = table(spark, folder, "documents")
    found = with_documents(_neighbours(spark, folder), documents, text="text")
    asked = documents.join(_vectors(spark, folder).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    framed = prompts(found, asked, query_key="doc_id", text="text")
    return framed.select("query_id", F.concat_ws("\n\n", "sources").alias("context"), "prompt")


@query("g6_question_prompts", r"""
with texts as (
  select 'd' as kind, cast(doc_id as varchar) as id, text from documents
  union all select 'q', concat_ws('-', conv_id, turn), text from conversations where role = 'user'
), words as (select kind, id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\t-\r ]+')) as word from texts),
buckets as (select kind, id, ('0x' || substring(md5(word), 1, 8))::bigint % 384 as bucket, count(*) as n
            from words where word <> '' group by all),
weights as (select *, cast(cast(n / sqrt(sum(n * n) over (partition by kind, id)) as float) as double) as w from buckets),
squares as (select kind, id, coalesce(sum(w * w), 0) as square from texts left join weights using (kind, id) group by all),
dots as (select q.id as query_id, d.id as doc_id, sum(q.w * d.w) as dot
         from weights q join weights d on q.kind = 'q' and d.kind = 'd' and q.bucket = d.bucket group by all),
ranked as (
  select q.id as query_id, d.id::bigint as doc_id, row_number() over (
           partition by q.id order by round(q.square + d.square - 2 * coalesce(dot, 0), 9), d.id::bigint) as rank
  from squares q join squares d on q.kind = 'q' and d.kind = 'd' left join dots on query_id = q.id and dots.doc_id = d.id
), sources as (
  select query_id, string_agg(text, e'\n\n' order by rank) as context, list(text order by rank) as sources
  from ranked join documents using (doc_id) where rank <= 3 group by query_id
)
select query_id, c.text as question, """ + prompt_sql(context="context", question="c.text") + """ as prompt, sources
from sources join conversations c on query_id = concat_ws('-', conv_id, turn) and role = 'user'""")
def g6_question_prompts(spark, folder):
    """Every user turn asks the documents, over word-bucket vectors of the whole texts."""
    asked = table(spark, folder, "conversations").where("role = 'user'")
    asked = asked.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))
    documents = table(spark, folder, "documents")
    path = scratch(spark, "vectors")
    write_vectors(bucket_vectors(documents.withColumnRenamed("text", "document"), "document"), path)
    return question_prompts(asked, read_vectors(spark, path), encode=bucket_vectors)
