import random
from collections import Counter

import numpy as np
import pyarrow as pa

from priceloom.llm import decontamination as d


def shingles(words, k):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(texts, items):
    """Pairs with a window that is at least 0.8 alike, and the best similarity."""
    out = {}
    for i, text in enumerate(texts):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        for item_id, item in items:
            own = "".join(c.lower() if c.isascii() else c for c in item or "").split()
            if not own:
                continue
            k = min(5, len(own))
            for at in range(len(words) - len(own) + 1):
                a, b = shingles(words[at:at + len(own)], k), shingles(own, k)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8:
                    out[i, item_id] = max(out.get((i, item_id), 0), round(s, 9))
    return out


def case():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(300)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([3, 5, 14, 30, 59])))) for j in range(25)]
    items += [(90, None), (91, ""), (92, "x x x x x x x x x x"), (93, items[3][1])]
    texts = [None, "", "x " * 30, "short"]
    for j in range(60):
        passage = items[rng.randrange(25)][1].split()
        if j % 3 == 0 and len(passage) > 13:
            passage[rng.choice([0, -1])] = "changed"
        if j % 5 == 0:
            passage[rng.randrange(len(passage))] = "other"
        texts.append(" ".join(rng.choices(words, k=20)) + "\n" + "  ".join(passage).upper() + "\t"
                     + " ".join(rng.choices(words, k=rng.randrange(9))))
    return texts, items


def test_against_brute_force(spark):
    texts, items = case()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.leak_report(rows, bench).collect()}
    expected = brute(texts, items)
    assert found == expected and len(expected) > 40
    clean = d.without_leaks(rows, bench)
    assert clean.columns == rows.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in expected})


def test_blocks_of_items(spark, monkeypatch):
    texts, items = case()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.leak_report(rows, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert len(list(d._blocks(bench))) > 2
    assert sorted(map(tuple, d.leak_report(rows, bench).collect())) == one


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = d.Index([(0, " ".join(f"w{i}" for i in range(20)))])
    _, _, prints, near, _ = index.classes[0]
    for _ in range(2000):
        flips = rng.choice(64, rng.integers(0, d.RADIUS + 1), replace=False)
        other = prints ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else prints
        blocks = other.view(np.uint8)
        assert any(near[b][blocks[b], 0] for b in range(8))


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert d.leak_report(rows, none).count() == 0 and d.without_leaks(rows, none).count() == 1
    assert d.leak_report(rows.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert d.Index([]).matches(pa.array(["a"])) == []


def test_recall_of_the_radius():
    """Windows altered at random to a similarity of 0.8 to 1 stay within the radius of their item."""
    rng = np.random.default_rng(5)
    distances = []
    for _ in range(20_000):
        m = int(rng.integers(11, 56))  # shingles of the benchmark's items
        item = rng.integers(0, 2**64, m, dtype=np.uint64)
        spare = int(m - np.ceil(2 * m * d.SIMILARITY / (1 + d.SIMILARITY)))
        window = item.copy()
        window[rng.choice(m, spare, replace=False)] = rng.integers(0, 2**64, spare, dtype=np.uint64)
        distances.append(int(np.bitwise_count(d.simhash(item[None])[0] ^ d.simhash(window[None])[0])))
    assert np.mean(np.array(distances) <= d.RADIUS) >= 0.999


def brute_with_short(texts, items):
    """As ``brute``, and a text shorter than the item is one window as a whole."""
    out = brute(texts, items)
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        for item_id, item in items:
            own = (item or "").lower().split()
            k = min(5, len(own))
            if k <= len(words) < len(own):
                a, b = shingles(words, k), shingles(own, k)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8:
                    out[i, item_id] = max(out.get((i, item_id), 0), round(s, 9))
    return out


def test_texts_shorter_than_an_item(spark):
    rng = random.Random(9)
    texts, items = case()
    items += [(100 + j, " ".join(rng.choices("abc", k=rng.randrange(6, 60)))) for j in range(10)]
    # The same passage at several lengths, and one that agrees only in shingles many items share.
    stem = [f"s{i}" for i in range(59)]
    items += [(200 + n, " ".join(stem[:n])) for n in (40, 45, 50, 55, 59)]
    for item_id, item in items:
        own = (item or "").split()
        for drop in range(1, len(own)):
            at = rng.randrange(drop + 1)
            passage = own[at:len(own) - drop + at]
            if drop % 3 == 2:
                passage[rng.randrange(len(passage))] = "other"
            texts.append((" ".join(passage)).upper() if drop % 2 else "\n".join(passage))
    texts.append(" ".join(stem[:55]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.leak_report(rows, bench).collect()}
    expected = brute_with_short(texts, items)
    assert found == expected and len(expected) > len(brute(texts, items)) + 100
    assert (len(texts) - 1, 259) in expected
    kept = sorted(r.doc_id for r in d.without_leaks(rows, bench).collect())
    assert kept == sorted(set(range(len(texts))) - {i for i, _ in expected})
