import random

import brute
import numpy as np
import pytest

from priceloom.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string, place string"


def found(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", "clash") for i, t in enumerate(texts)]
    return simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(60)]
    out = [None, "", " \t\n", "one", "One", "a b c", "A\x0bb\fc", "é É é É", "word " * 3000]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 30, 200]))
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            edited = list(base)
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out.append("  ".join(edited).upper())
    return out


def test_against_brute_force(spark):
    data = texts()
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in found(spark, data)}
    prints = [brute.simhash(t) for t in data]
    groups = brute.components(prints, 4)
    assert [rows[i] for i in range(len(data))] == [(f"{p:016x}", c) for p, c in zip(prints, groups)]
    assert len(set(groups)) < len(groups)


@pytest.mark.parametrize("tile, shared", [(4, None), (1024, None), (1024, 5)])
def test_random_fingerprints(spark, tile, shared):
    rng = random.Random(11)
    prints = []
    for _ in range(40):
        center = rng.getrandbits(64)
        for _ in range(20):
            value = center
            for bit in rng.sample(range(64), rng.randrange(6)):
                value ^= 1 << bit
            prints.append(value)
    distinct = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in distinct]
    linked = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=tile, shared=shared)
    roots = {r.node: r.root for r in components.connected_components(linked).collect()}
    groups = brute.components(distinct, 4)
    by_group = {}
    for p, g in zip(signed, groups):
        by_group.setdefault(g, set()).add(p)
    assert all(roots.get(p, p) == min(by_group[g]) for p, g in zip(signed, groups))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2))
    plain = [sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
             for a, b in zip(x.tolist(), y.tolist())]
    assert simhash.manhattan(simhash._embedded(x), simhash._embedded(y)).tolist() == plain
    assert (np.array(plain) <= np.bitwise_count(x ^ y)).all()


def test_nulls_and_repeats(spark):
    rows = found(spark, ["same text here", "same text here", "same text here", None], [None, 7, 7, None])
    assert sorted((str(r.doc_id), r.component_id) for r in rows if r.fingerprint != "0" * 16) == [
        ("7", 7), ("7", 7), ("None", 7)]
    assert [r.component_id for r in rows if r.fingerprint == "0" * 16] == [None]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(None, "same text here now", 1), (5, "same text here now", 2), (5, "same text here now", 2),
            (3, "other words in this one", 3), (None, "alone without any number", 4), (None, None, 5)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert sorted((r.doc_id or 0, r.row) for r in kept) == [(0, 4), (0, 5), (3, 3), (5, 2)]


def test_rows_equal_in_id_and_text_leave_the_same_one(spark):
    rows = [(1, "some words in this text", i) for i in range(40)]
    kept = {simhash.without_near_duplicates(spark.createDataFrame(order, "doc_id long, text string, n int")).collect()[0].n
            for order in (rows, rows[::-1], rows[20:] + rows[:20])}
    assert len(kept) == 1


def test_more_fingerprints_give_smaller_cells():
    chosen = [simhash.shared_groups(10 ** n, simhash.RADIUS) for n in range(13)]
    assert chosen == sorted(chosen) and chosen[0] == 3 and chosen[9] > 3
    for shared in simhash.SHARED:
        masks = simhash._masks(simhash.RADIUS, shared)
        assert len(masks) == simhash.comb(simhash.RADIUS + shared, shared)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 100), (None, 3), (70, 60)], "a long, b long")
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 60: 60, 70: 60}
