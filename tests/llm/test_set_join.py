import random
import re

import numpy as np
import pytest

from priceloom.llm import set_join

SCHEMA = "doc_id long, text string, key string, place string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))}


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, set_join.similar_sets(df, **options).collect()), key=repr)


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 7))) for _ in range(400)]
    common = rng.choices(vocabulary, k=40)
    texts = [None, "", " \n", "one", "ONE", "one two", "a\x0bb c", "a b c", "é É é", "x " * 500, "long" * 50_000]
    for size in [3, 8, 11, 12, 13, 20, 21, 24, 33, 60, 61, 150, 400, 1100, 1300]:
        for _ in range(3):
            base = rng.choices(vocabulary, k=size) + (common if size in (60, 150) else [])
            texts.append(" ".join(base))
            for _ in range(rng.randrange(2, 6)):
                base = list(base)
                for _ in range(rng.randrange(1, 1 + max(1, size // 40))):
                    at = rng.randrange(len(base))
                    base[at:at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
                texts.append("  ".join(base).upper())
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[20], (rows[20][0], "another text with this id"), (None, rows[21][1]), (None, "nobody else says this")]


@pytest.mark.parametrize("limit", [None, 0, 26])
def test_against_brute_force(spark, limit):
    rows = corpus()
    expected = plain(rows)
    assert len({c for *_, c in expected}) < len(expected) - 60
    assert found(spark, rows, limit=limit) == expected


def test_long_lists_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(set_join, "LIST_MEMBERS", 3)
    monkeypatch.setattr(set_join, "TILE_SHINGLES", 300)
    rows = corpus()
    assert found(spark, rows, limit=12) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_chunks_of_a_long_text(monkeypatch):
    text = " ".join(str(i * i) for i in range(2000)).encode()
    whole = set_join.Shingles().of(text)
    monkeypatch.setattr(set_join, "_CHUNK", 37)
    assert set_join.Shingles().of(text).tolist() == whole.tolist()
    assert len(whole) == 1998


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (20, 1000, 1030, 5000):
        a = np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 15:], rng.integers(0, 2**64 - 1, size // 30, dtype=np.uint64)]))
        near = set_join._near_by_sketch(np.array([len(a), len(b)]), [set_join.sketch(x).tobytes() for x in (a, b)], 80, 0)
        assert near(0, np.array([1])).tolist() == [True]


def test_boundary_follows_cost():
    assert set_join.boundary({}) == 0
    assert set_join.boundary({8: 10, 500: 10}) >= 8
    assert set_join.boundary({s: 100 for s in range(1, 54)}) < 30
