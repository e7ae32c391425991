import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from priceloom.llm import language, quality_model
from priceloom.llm.split import held_out

WORDS = {"en": "the of and this with water house there", "de": "der die und nicht ist mit wasser haus straße",
         "fr": "le la des être où avec pas maison"}


def labelled(n=240):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(5, 60)))
        bad = i % 4 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, lang, int(not bad)))
    return rows


def test_languages(spark):
    rows = [(i, t, lang, "clash") for i, t, lang, _ in labelled()]
    rows += [(1000, None, "en", ""), (1001, "123 !?", "de", ""), (None, "the house", None, ""), (1002, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    found = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    assert {found[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and found[None].lang_pred == "en"
    assert all(found[i].lang_pred == lang for i, _, lang, _ in rows[:240] if found[i].held_out)


def test_language_scores_follow_counts_by_hand(spark):
    docs = [("ab", "x"), ("ab b", "x"), ("bc", "y")]
    langs, matrix, prior = language.fit(spark.createDataFrame(docs, "text string, lang string"))
    assert langs == ["x", "y"] and np.allclose(np.exp(prior), [2 / 3, 1 / 3])
    expected = np.full((2, language.BUCKETS), language.SMOOTHING)
    for text, lang in docs:
        buckets, _, _ = language.grams([text])
        np.add.at(expected[langs.index(lang)], buckets.ravel(), 1)
    assert np.allclose(matrix, np.log(expected / expected.sum(axis=1, keepdims=True)))


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    alone, _, _ = language.grams(["été 12x"])
    among, starts, letters = language.grams(["zz", "été 12x", "qq"])
    assert (among[:, starts[1]:starts[2]] == alone).all() and letters.tolist() == [2, 4, 2]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.language_report(docs).first().lang_pred == "und"
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.quality_report(docs, labels).first().score == 0.5
    assert quality_model.quality_report(docs.limit(0), labels).count() == 0


def test_held_out(spark):
    import zlib

    found = spark.range(50).select("id", held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in found)


def test_quality(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 9) for i, t, _, _ in rows] + [(500, None, 9), (501, "", 9), (None, "the of", 9)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q, 1) for i, _, _, q in rows] + [(500, 1, 0), (None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, label int")
    found = {r.doc_id: r for r in quality_model.quality_report(docs, labels).collect()}
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 for r in found.values())
    right = [found[i].predicted == q for i, _, _, q in rows if found[i].held_out]
    assert sum(right) >= 0.95 * len(right) and found[500].score == found[501].score


def test_features_do_not_depend_on_neighbours():
    one = quality_model.features(pa.array(["The CAT!! sat sat"]))[0]
    three = quality_model.features(pa.array(["x y", "The CAT!! sat sat", None]))
    assert sorted(set(three[1].tolist())) == sorted(set(one.tolist())) and len(three[2]) == 0


def test_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    target = np.where([5 in r or 7 in r for r in rows], 1.0, -1.0)
    scale = rng.normal(1, 0.3, 30)
    weights = quality_model.descend(rows, target, scale, np.full(60, 1.0), epochs=400)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - target * quality_model.margins(rows, scale, w)).sum()

    best = loss(weights)
    assert all(loss(weights + rng.normal(0, 0.02, 31)) >= best - 1e-6 for _ in range(200))


def test_counts_cover_all_rows_and_the_sample_is_bounded(spark):
    rows = [(i, t, q) for i, t, _, q in labelled()]
    learning = spark.createDataFrame(rows, "doc_id long, text string, label int")
    small = quality_model.fit(learning, sample=40)
    large = quality_model.fit(learning, sample=4000)
    assert np.allclose(small["scale"], large["scale"]) and not np.allclose(small["weights"], large["weights"])
    assert learning.where(F.col("label") == 0).count() == 60
