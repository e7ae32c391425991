import hashlib
import zlib

import pytest

from priceloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(nodes):
    """The root of a list of digests and the sibling runs of each."""
    siblings = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for j in range(len(run)):
                for i in owners[at + j]:
                    siblings[i].append((run[:j], run[j + 1:]))
            up.append(sha(*run))
            above.append([i for group in owners[at:at + 8] for i in group])
        nodes, owners = up, above
    return nodes[0], siblings


def plain(rows):
    """What the report must hold for ``(doc_id, text, lang, source, n_chars)`` rows, in any order."""
    keyed = [(leaf(d, s, lang, n, t), d, t, lang, s, n) for d, t, lang, s, n in rows]
    langs = sorted({r[3] for r in keyed}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in keyed if r[3] == lang), key=lambda r: (r[1] is not None, r[1] or 0, r[0])) for lang in langs]
    low = [tree([r[0] for r in g]) for g in groups]
    root, high = tree([subroot for subroot, _ in low])
    out = []
    for g, (subroot, paths), top in zip(groups, low, high):
        for (own, d, t, lang, s, n), path in zip(g, paths):
            shown = own
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t is not None:
                shown = leaf(d, s, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
            fold = shown
            for left, right in path + top:
                fold = sha(*left, fold, *right)
            proof = sha(*[x for left, right in path + top for x in left + right])
            out.append((d, own, subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def found(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, merkle.manifest_report(df).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 9, 600])
def test_one_language_of_any_size(spark, n):
    rows = [(i * 7 % 1009, f"Text {i} É", "en", f"s{i % 3}", i) for i in range(n)]
    assert found(spark, rows) == plain(rows)


def test_languages_nulls_and_repeats(spark):
    rows = [(i, f"T{i}", f"l{i % 83}", None, None) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "", None, "", 0), (5, "same", "en", "s", 1), (5, "same", "en", "s", 1),
             (5, "OTHER", "en", "s", 1), (-3, "A" * 100_000, "é", "s", 2), (1, "A:-", "", "-", -1)]
    assert found(spark, rows) == plain(rows)


def test_salted_ancestors(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MEET", 2)
    rows = [(i, f"Text {i}", "en" if i % 3 else "de", "s", i) for i in range(700)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
