import math
import random

import numpy as np
import pytest

from priceloom.llm import hard_negatives as hn
from priceloom.operators import blocks

SCHEMA = "vec_id long, embedding array<float>, label int, row string, slot string"


def plain(rows):
    """The first negatives of every anchor and positive, by trying all rows."""
    ready = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        entry = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole)
        if entry not in ready:
            ready.append(entry)
    out = []
    for a, label, v in ready:
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in ready if b != a and len(w) == len(v)]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in order if s[2] == label][:5]:
            hits = [s for s in order if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, pid, i + 1, n, p, score) for i, (score, n, _) in enumerate(hits)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(2)
    return sorted(map(tuple, hn.mined(df).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def data(n, dims=6):
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        center = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, 0.4) for x in center], rng.randrange(10)))
    hot = rows[50][1]
    rows += [(n + i, hot, 3) for i in range(n // 3)]  # ties
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(blocks, "LEFT_ROWS", 3)
        monkeypatch.setattr(hn, "ROWS_AT_ONCE", 2)
        monkeypatch.setattr(hn.compare_blocks, "__defaults__", (3, 40))
    rows = data(400)
    expected = plain(rows)
    assert len(expected) > 50
    assert found(spark, rows) == expected


def test_nulls_lengths_and_repeats(spark):
    rows = data(60) + [(None, [1.0] * 6, 1), (50, None, 1), (400, [1.0] * 6, None), (401, [None] * 6, 1),
                       (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (404, [], 1), (450, [], 1), (455, [], 2),
                       (500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (502, [0.7, 1.5], 2), (502, [0.7, 1.5], 2), (-50, [0.5] * 6, 4)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_large_numbers_are_exact():
    a = np.array([[1 << 40, -3], [1 << 62, 1 << 62]], dtype=np.int64)
    plain_scores = a.astype(object) @ a.astype(object).T
    assert hn.scores(a, a).tolist() == [[min(x, (1 << 63) - 1) for x in row] for row in plain_scores.tolist()]
