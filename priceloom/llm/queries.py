"""The registered queries of this package and the SQL that checks them."""

import public_tokenizers
from pyspark.sql import functions as F

from priceloom.llm import (bpe, decontamination, hard_negatives, language, merkle, private_data, quality_model,
                           quality_rules, repeats, set_join, simhash, token_counts, warc)
from priceloom.llm.oracles import ORACLES as ORACLES

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query
def op1_suffix_array_dedup(spark, folder):
    return repeats.repeat_report(documents(spark, folder), threshold=400)


@query
def op2_warc_revisits(spark, folder):
    return warc.archive_report(spark, table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op3_quality_classifier(spark, folder):
    return quality_model.quality_report(documents(spark, folder), table(spark, folder, "labels"), threshold=0.7)


@query
def op4_benchmark_decontamination(spark, folder):
    return decontamination.leak_report(documents(spark, folder), table(spark, folder, "benchmark"))


@query
def op5_quality_rules(spark, folder):
    found = quality_rules.quality_rules(documents(spark, folder))
    return found.select("row.doc_id", *[F.col("quality").getField(c).alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query
def op6_token_counts(spark, folder):
    return token_counts.token_report(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_language_id(spark, folder):
    return language.language_report(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query
def op8_private_data(spark, folder):
    return private_data.private_report(documents(spark, folder))


@query
def op9_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(documents(spark, folder))


@query
def op10_bpe_round_trip(spark, folder):
    return bpe.bpe_report(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_ngram_jaccard_join(spark, folder):
    return set_join.similar_sets(documents(spark, folder))


@query
def op12_hard_negatives(spark, folder):
    return hard_negatives.mined(table(spark, folder, "embeddings"))


@query
def op13_merkle_manifest(spark, folder):
    return merkle.manifest_report(table(spark, folder, "documents").select(*merkle.FIELDS))
