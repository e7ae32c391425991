import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import priceloom.operators.retrieval as retrieval
from priceloom.functions.text import answer_only, listing_document
from priceloom.operators.drift import check_drift, drift_report
from priceloom.operators.retrieval import (
    document_corpus,
    encoded_vectors,
    hashed_vectors,
    nearest_documents,
    prompts,
    with_documents,
)
from priceloom.operators.summary import training_stats
from priceloom.operators.training import fit_model
from priceloom.plans.workflows import DISCOUNT_MODEL, PRICE_MODEL, question_prompts, train_all
from priceloom.schema import DISCOUNT_FEATURES, DISCOUNT_TARGET, SCENARIOS
from priceloom.sources.models import load_model
from priceloom.sources.stats import STATS_SCHEMA, display_stats, read_stats, write_stats
from priceloom.sources.vectors import read_vectors, write_vectors
from priceloom.streaming.scoring import read_requests, score_stream, scored_with_drift, within_bounds

STATS = [("actual_price", 1000.0, 200.0), ("discounted_price", 600.0, 150.0), ("rating", 4.0, 0.3),
         ("rating_count", 10000.0, 5000.0)]


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(STATS, STATS_SCHEMA)


def test_no_drift(spark, stats):
    df = spark.createDataFrame([(950.0, 580.0)], "actual_price double, discounted_price double")
    row = check_drift(df, stats, df.columns).first()
    assert row.drift_detected is False and row.z_scores == {"actual_price": 0.25, "discounted_price": 0.133}


def test_drift(spark):
    stats = spark.createDataFrame([("actual_price", 1000.0, 10.0)], STATS_SCHEMA)
    df = spark.createDataFrame([(99999.0, 1.0)], "actual_price double, extra double")
    row = check_drift(df, stats, df.columns).first()
    assert row.drift_detected is True and set(row.z_scores) == {"actual_price"}


def test_drift_edges(spark, stats):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1600.0), (2, 1600.1), (3, nan), (4, None), (5, -1e9)], "id int, actual_price double")
    got = {r.id: r for r in check_drift(df, stats, ["actual_price"]).collect()}
    assert [got[i].drift_detected for i in range(1, 6)] == [False, True, False, False, True]
    assert np.isnan(got[3].z_scores["actual_price"]) and got[4].z_scores == {}
    constant = spark.createDataFrame([("actual_price", 5.0, 0.0)], STATS_SCHEMA)
    row = check_drift(df.limit(1), constant, ["actual_price"]).first()
    assert row.drift_detected is False and row.z_scores == {"actual_price": 0.0}
    one = training_stats(df.where("id = 1"), ["actual_price"])
    assert check_drift(df.where("id = 5"), one, ["actual_price"]).first().z_scores == {"actual_price": 0.0}
    report = drift_report(df, stats, ["actual_price"]).first()
    assert (report.checked, report.flagged) == (4, 2) and report.max_z == pytest.approx(5000005.0)


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_stats_round_trip(spark, stats, tmp_path, kind):
    path = str(tmp_path / "stats")
    write_stats(stats, path, kind)
    assert sorted(map(tuple, read_stats(spark, path, kind).collect())) == STATS
    assert display_stats(read_stats(spark, path, kind)).columns == ["feature", "Mean", "Std Dev"]


@pytest.fixture(scope="module")
def requests(spark):
    rng = np.random.default_rng(9)
    rows = [(f"P{i}", *map(float, (rng.uniform(100, 3000), rng.uniform(50, 900), rng.uniform(1, 5), rng.integers(1, 9000))),
             float(rng.integers(0, 90))) for i in range(300)]
    return spark.createDataFrame(rows, "product_id string, " + ", ".join(f"{c} double" for c in DISCOUNT_FEATURES)
                                 + f", {DISCOUNT_TARGET} double")


def test_response_shape(spark, requests, stats):
    model = fit_model(requests, "Linear Regression", DISCOUNT_FEATURES, DISCOUNT_TARGET)
    ask = spark.createDataFrame([(999.0, 599.0, 4.2, 1000.0)], ", ".join(f"{c} double" for c in DISCOUNT_FEATURES))
    row = scored_with_drift(ask, model, stats).first()
    assert list(row.asDict()) == ["predicted_discount_percentage", "drift_warning", "drift_details", "inputs"]
    assert row.inputs.rating == 4.2 and row.predicted_discount_percentage == round(row.predicted_discount_percentage, 2)
    bare = scored_with_drift(ask, model).first()
    assert bare.drift_warning is False and bare.drift_details == {}
    scenarios = spark.createDataFrame(SCENARIOS, "scenario string, " + ", ".join(f"{c} double" for c in DISCOUNT_FEATURES))
    assert scored_with_drift(within_bounds(scenarios), model, stats).count() == 3
    assert within_bounds(scenarios.withColumn("rating", F.lit(5.5))).count() == 0


def test_stream_equals_batch_and_resumes(spark, requests, stats, tmp_path):
    model = fit_model(requests, "Random Forest", DISCOUNT_FEATURES, DISCOUNT_TARGET, {"n_estimators": 50, "max_depth": 4})
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests.limit(200).repartition(4).write.parquet(inbox)
    late = requests.subtract(spark.read.parquet(inbox))

    def run():
        stream = read_requests(spark, inbox, requests.schema, files_per_trigger=1)
        score_stream(stream, model, stats, out, available_now=True).awaitTermination()

    def rows(df):
        return sorted((r.product_id, r.predicted_discount_percentage, r.drift_warning, tuple(sorted(r.drift_details.items())))
                      for r in df.collect())

    run()
    late.write.mode("append").parquet(inbox)
    run()
    expected = scored_with_drift(requests, model, stats)
    assert rows(spark.read.parquet(out)) == rows(expected)
    assert expected.where("drift_warning").count() > 0


def brute(queries, corpus, k):
    found = []
    for q, (x, n) in queries.items():
        d = sorted((float(((np.float64(x) - np.float64(y)) ** 2).sum()), i) for i, y in corpus.items())
        found += [(q, rank + 1, i, dist) for rank, (dist, i) in enumerate(d[: n or k])]
    return sorted(found)


def vectors(spark, table, key):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in table.items()], f"{key}, embedding array<float>")


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("blocks", [(2048, 4096), (7, 40)])
def test_neighbours_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "QUESTION_ROWS", blocks[0])
    monkeypatch.setattr(retrieval, "DOCUMENT_ROWS", blocks[1])
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 100 * blocks[0])
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8)).astype(np.float32)
    # Half of the corpus is copies of one vector: ties must go to the smaller key.
    corpus = {f"d{i:03d}": base[0] if i % 2 else base[i] for i in range(150)}
    asked = {i: (base[i] * np.float32(1 + 0.1 * (i % 3)), 1 + i % 5) for i in range(40)}
    queries = spark.createDataFrame([(i, [float(v) for v in x], n) for i, (x, n) in asked.items()],
                                    "query_id int, embedding array<float>, top_k int")
    got = as_rows(nearest_documents(queries, vectors(spark, corpus, "doc_id string").repartition(7)))
    expected = brute(asked, corpus, 3)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-12)


def test_short_and_empty_corpus(spark):
    corpus = vectors(spark, {1: [0.0, 1.0], 2: [0.0, 3.0]}, "doc_id long")
    queries = vectors(spark, {"a": [0.0, 2.0]}, "query_id string")
    assert as_rows(nearest_documents(queries, corpus, 5)) == [("a", 1, 1, 1.0), ("a", 2, 2, 1.0)]
    assert nearest_documents(queries, corpus.where("doc_id > 9"), 5).count() == 0
    assert nearest_documents(queries.where("query_id = 'z'"), corpus).count() == 0


def test_pluggable_encoder(spark):
    def make_encoder():
        def encode(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return encode

    df = spark.createDataFrame([("banana",), ("kiwi",), ("",)], "t string")
    assert [list(r.embedding) for r in encoded_vectors(df, "t", make_encoder).collect()] == [[6.0, 3.0], [4.0, 0.0], [0.0, 0.0]]


def test_hashed_vectors(spark, tmp_path):
    long = "word " * 5000 + "tail"
    df = spark.createDataFrame([(1, "Red cable"), (2, "red  CABLE\n"), (3, ""), (4, None), (5, long)], "doc_id int, document string")
    got = {r.doc_id: np.array(r.embedding) for r in hashed_vectors(df, "document").collect()}
    assert all(len(v) == 384 for v in got.values())
    assert (got[1] == got[2]).all() and np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert not got[3].any() and not got[4].any() and (got[5] > 0).sum() == 2
    path = str(tmp_path / "vectors")
    write_vectors(hashed_vectors(df, "document"), path)
    assert read_vectors(spark, path).columns == ["doc_id", "document", "embedding"] and read_vectors(spark, path).count() == 5


def test_document_text(spark):
    row = ("Cable", None, 399.5, 1098.5, 64.0, 4.0, 24269.0, "a" * 250, "r" * 250)
    names = ["product_name", "category", "discounted_price", "actual_price", "discount_percentage", "rating", "rating_count",
             "about_product", "review_content"]
    kinds = ["string", "string", *["double"] * 5, "string", "string"]
    df = spark.createDataFrame([row], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    assert df.select(listing_document()).first()[0] == (
        "Product: Cable. Category: nan. Price: ₹400 (was ₹1098, 64% off). Rating: 4.0/5 from 24269 reviews. "
        f"About: {'a' * 200}. Review: {'r' * 200}.")
    assert document_corpus(df.withColumn("product_id", F.lit("A"))).columns == ["doc_id", "document"]


def test_answers(spark):
    texts = ["no mark", "Answer: yes\n", "Answer: a Answer:  b \t", "Answer:", " kept "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(answer_only(F.col("t"))).collect()] == ["no mark", "yes", "b", "", " kept "]


def test_prompt_text(spark):
    questions = spark.createDataFrame([("q1", "Which?", [0.0]), ("q2", "What?", [9.0])],
                                      "query_id string, question string, embedding array<float>")
    corpus = spark.createDataFrame([(i, f"doc {i}", [float(i)]) for i in range(10)],
                                   "doc_id int, document string, embedding array<float>")
    found = with_documents(nearest_documents(questions, corpus, 2), corpus)
    got = {r.query_id: r for r in prompts(found, questions).collect()}
    assert got["q2"].sources == ["doc 9", "doc 8"]
    assert got["q1"].prompt == (
        "You are a helpful e-commerce assistant. Answer the question using only the product information provided below.\n\n"
        "Product Information:\ndoc 0\n\ndoc 1\n\nQuestion: Which?\n\nAnswer:")


def test_every_question_has_a_prompt(spark):
    corpus = spark.createDataFrame([(1, "red lamp", "v"), (2, "blue pen", "v")], "doc_id long, document string, extra string")
    corpus = retrieval.bucket_vectors(corpus, "document")
    rows = [("a", "lamp"), ("a", "pen"), ("b", None), (None, "red")]
    asked = spark.createDataFrame(rows, "query_id string, question string")
    got = question_prompts(asked, corpus, 1, encode=retrieval.bucket_vectors).collect()
    assert sorted((str(r.query_id), str(r.question), tuple(r.sources)) for r in got if r.question) == [
        ("None", "red", ("red lamp",)), ("a", "lamp", ("red lamp",)), ("a", "pen", ("blue pen",))]
    nothing = question_prompts(asked, corpus.where("doc_id > 5"), 1, encode=retrieval.bucket_vectors).collect()
    assert len(nothing) == 4 and all(r.sources == [] for r in nothing)


def test_vectors_that_are_missing_or_not_numbers(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")]), (4, [3.0])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [0.0]), ("b", None), ("c", [float("nan")])], "query_id string, embedding array<float>")
    assert as_rows(nearest_documents(asked, corpus, 3)) == [("a", 1, 1, 1.0), ("a", 2, 4, 9.0)]


def test_training_and_questions_end_to_end(spark, tmp_path, sample_rows):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        actual, percent = int(rng.integers(200, 5000)), int(rng.integers(5, 90))
        rows.append({**{c: v[i % 3] for c, v in sample_rows.items()}, "product_id": f"P{i}", "product_name": f"gadget{i} cable",
                     "actual_price": f"₹{actual:,}", "discounted_price": f"₹{actual * (100 - percent) // 100:,}",
                     "discount_percentage": f"{percent}%", "rating": f"{rng.integers(10, 51) / 10}"})
    path, folder = str(tmp_path / "listings.csv"), str(tmp_path / "out")
    pd.DataFrame(rows).to_csv(path, index=False)
    report = train_all(spark, path, folder, trees=50, max_depth=5)
    assert report["rows"] == 120 and report["price"]["r2"] > 0.5
    assert json.dumps(report)
    model = load_model(folder, DISCOUNT_MODEL)
    assert load_model(folder, PRICE_MODEL) is not None
    listings = spark.read.parquet(f"{folder}/listings")
    assert scored_with_drift(listings.select("product_id", *DISCOUNT_FEATURES), model,
                             read_stats(spark, f"{folder}/training_stats")).count() == 120
    questions = spark.createDataFrame([("q", "Product: gadget7 cable.")], "query_id string, question string")
    row = question_prompts(questions, read_vectors(spark, f"{folder}/vectors")).first()
    assert len(row.sources) == 3 and row.prompt.endswith("Question: Product: gadget7 cable.\n\nAnswer:")


def test_repeated_questions_are_questions_of_their_own(spark):
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [0.0, 0.0], 1), ("a", [5.0, 0.0], 2), ("a", [5.0, 0.0], 2)],
                                  "query_id string, embedding array<float>, top_k int")
    found = nearest_documents(asked, corpus).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found) == [
        ("a", 1, 0), ("a", 1, 5), ("a", 1, 5), ("a", 2, 4), ("a", 2, 4)]


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """Blocks are written once and met in place: no row is copied for every block of the other side."""
    monkeypatch.setattr(retrieval, "QUESTION_ROWS", 10)
    monkeypatch.setattr(retrieval, "DOCUMENT_ROWS", 10)
    corpus = spark.createDataFrame([(i, [float(i % 97), float(i % 89)]) for i in range(300)], "doc_id long, embedding array<float>")
    found = nearest_documents(corpus.withColumnRenamed("doc_id", "query_id"), corpus, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "embedding" not in plan
    assert found.count() == 600 and found.where("rank = 1 and doc_id = query_id and distance = 0").count() == 300


def test_parts_of_the_documents_are_bounded():
    from priceloom.operators.blocks import BLOCKS_IN_PART, RIGHT_PARTS, parts_of

    assert [parts_of(100, n) for n in (1, 10, 1000)] == [1, 10, RIGHT_PARTS]
    assert parts_of(1, 100) == 100 and parts_of(100, 100 * BLOCKS_IN_PART) == 100


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e18, 1e100])
def test_neighbours_at_any_scale(spark, scale):
    """Rounded products rule out no neighbour, whatever the size of the numbers."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(1200, 5)) * scale
    points[600:] = points[:600] + rng.normal(size=(600, 5)) * scale * 1e-6
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(points)] + [(2000, [1e200] * 5)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    got = as_rows(nearest_documents(corpus.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id"), corpus, 3))
    expected = brute({i: (points[i], 3) for i in range(0, 1200, 10)}, dict(enumerate(points)), 3)
    assert [g[:3] for g in got] == [e[:3] for e in expected]


def test_blocks_are_prepared_once(monkeypatch):
    """Not for every share of the questions, and the questions not for every block of documents."""
    rng = np.random.default_rng(8)
    prepared, rounded = [], retrieval._rounded
    monkeypatch.setattr(retrieval, "_rounded", lambda vectors, *more: prepared.append(len(vectors)) or rounded(vectors, *more))
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 90)

    def block(n, **more):
        return pa.table({**more, "embedding": pa.array(rng.normal(size=(n, 4)).astype(np.float32).tolist(), pa.list_(pa.float32()))})

    questions = block(50, number=np.arange(50), query_id=np.arange(50), top_k=np.full(50, 3))
    documents, found = [block(30, doc_id=np.arange(30) + 100 * i) for i in range(4)], None
    for part in documents:
        found = retrieval._nearest_of_blocks(questions, part, found)
    assert sorted(prepared) == [30, 30, 30, 30, 50]
    q, c = (np.array(t.column("embedding").to_pylist()) for t in (questions, pa.concat_tables(documents)))
    ids = np.concatenate([t.column("doc_id").to_numpy() for t in documents])
    nearest = ids[np.argsort(((q[:, None] - c) ** 2).sum(axis=2), axis=1)[:, :3]]
    assert (found.column("doc_id").to_numpy().reshape(50, 3) == nearest).all()


def test_few_distances_decide():
    """Exact distances are computed for about as many documents as are asked for, also where no bound is known."""
    rng = np.random.default_rng(9)
    q, c, limits = rng.normal(size=(40, 8)), rng.normal(size=(3000, 8)), rng.integers(1, 6, 40)
    c[7] = c[2000]
    q_norm, c_norm, slack = (q**2).sum(axis=1), (c**2).sum(axis=1), 48 * 2.0**-23
    wide = [retrieval._rounded(x, last, np.float32) for x, last in ((q, 1.0), (c, c_norm * (slack - 0.5)))]
    i, j = retrieval._close(wide[0], q_norm, wide[1], c_norm, limits, np.full(40, np.inf), slack)
    assert len(i) < 2 * limits.sum()
    distance = ((q[:, None] - c) ** 2).sum(axis=2)
    for question, limit in enumerate(limits):
        last = np.sort(distance[question])[limit - 1]
        assert set(np.flatnonzero(distance[question] <= last)) <= set(j[i == question])
