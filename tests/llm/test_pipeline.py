import brute
import public_tokenizers
import pyarrow.parquet as pq
from test_bpe import digests
from tokenizers import Tokenizer

import corpus_pipeline
from priceloom.llm import quality_rules

FOLDER = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    """Every stage but the masking is redone plainly; texts with personal data are compared by presence only."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.row.doc_id for r in quality_rules.quality_rules(docs).where("quality.kept").collect()}
    rows = sorted((d["doc_id"], d["text"]) for d in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
                  if d["doc_id"] in kept)
    groups = brute.components([brute.simhash(t) for _, t in rows], 4)
    rows = [row for i, row in enumerate(rows) if groups[i] == i]
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()

    def shingles(words):
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    bench = [shingles(item["text"].lower().split()) for item in items]
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
             for r in corpus_pipeline.run(spark, FOLDER).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in rows:
        share = max(len(b & shingles(text.lower().split())) / len(b) for b in bench)
        if share == 1:
            assert doc_id not in found
        elif share < 0.5:
            assert doc_id in found
            if not brute.base_spans(text) and "=" not in text:
                assert found[doc_id] == digests(library, text)
    assert set(found) <= {doc_id for doc_id, _ in rows}


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "private_data", "bpe_round_trip"]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, FOLDER).columns == docs.columns
