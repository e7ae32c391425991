import random

import brute
import pytest
from pyspark import cloudpickle

from priceloom.llm import arrays, repeats

SCHEMA = "doc_id long, text string, key string, run int"


def report(spark, texts, threshold):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            for r in repeats.repeat_report(spark.createDataFrame(rows, SCHEMA), threshold).collect()}


def corpus(rng):
    passage = "".join(rng.choices("abcdé ", k=150))
    texts = ["", None, "short", "a" * 50, "ab" * 40, passage, passage + "x", "y" + passage + "z" + passage[:80]]
    texts += [passage, passage]
    for _ in range(30):
        a, b = rng.randrange(150), rng.randrange(150)
        texts.append("".join(rng.choices("abcdefghij", k=rng.randrange(40))) + passage[min(a, b):max(a, b)]
                     + "".join(rng.choices("abcdefghij", k=rng.randrange(40))))
    texts += ["".join(rng.choices("ab", k=rng.randrange(120))) for _ in range(20)]
    return texts


@pytest.mark.parametrize("threshold", [8, 75])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, threshold):
    texts = corpus(random.Random(seed))
    found = report(spark, texts, threshold)
    assert [found[i] for i in range(len(texts))] == brute.removed(texts, threshold)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 50)
    monkeypatch.setattr(arrays, "SLICE_BYTES", 50)
    rng = random.Random(5)
    data = []
    for text in corpus(rng):
        raw = (text or "").encode()
        data += [(b - begin, a - begin) for _, begin, a, b in repeats._pieces(raw, repeats.np.array([0, len(raw)]), 8)]
        assert data[-1][0] == len(raw)


def test_empty(spark):
    assert repeats.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    long = "q" * 500
    rows = [(None, long), (1, long), (1, long), (1, None), (2, "w")]
    found = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in found) == [
        (0, 500, 500), (1, 0, 0), (1, 500, 500), (1, 500, 500), (2, 1, 0)]


@pytest.mark.parametrize("threshold", [8, 75])
@pytest.mark.parametrize("piece", [50, 110])
def test_texts_in_pieces_against_brute_force(spark, monkeypatch, piece, threshold):
    monkeypatch.setattr(repeats, "SLICE_BYTES", piece)
    monkeypatch.setattr(repeats, "slices", lambda batch, column: arrays.slices(batch, column, piece))
    rng = random.Random(7)
    texts = corpus(rng)
    # Near copies of long texts: with an earlier insertion the pieces are cut elsewhere in them.
    for _ in range(6):
        long = "".join(rng.choices("abcdefghij", k=rng.randrange(200, 700)))
        texts += [long, "x" * rng.randrange(1, 40) + long, long[:90] + "y" * rng.randrange(1, 40) + long[90:]]
    cloudpickle.register_pickle_by_value(repeats)  # so that tasks cut as this process does
    try:
        found = report(spark, texts, threshold)
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    assert [found[i] for i in range(len(texts))] == brute.removed(texts, threshold)
