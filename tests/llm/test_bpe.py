import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from priceloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def in_leaves(tool, text, size):
    """Encode by halves down to a small size, without Spark."""
    ids = []
    for _, group in bpe.groupby(tool.leaves(text, size), key=lambda x: x[0]):
        ids += tool.tree([tool.leaf(part) for _, part in group]).tolist()
    return ids


def texts():
    rng = random.Random(9)
    words = "the and tion ing don't we'll 123 4567 é ñandú 你好 𝒳 !!! ... <|endoftext|> \n \n\n \t   x".split(" ")
    out = ["", " ", "\n", "a", "<|endoftext|>", "<|endoftext|", "a <|endoftext|><|endoftext|> b", "\x00\x85\xa0 "]
    for _ in range(60):
        out.append(" ".join(rng.choices(words, k=rng.randrange(200))))
        out.append("".join(rng.choices(words, k=rng.randrange(200))))
    for alphabet in ("a", "ab", "abcdehnorst", "0123456789", "!?-", " ", "\n ", "é你", "anti"):
        out.append("".join(rng.choices(alphabet, k=700)))
        out.append("x " + "".join(rng.choices(alphabet, k=300)) + " y." + "".join(rng.choices(alphabet, k=90)))
    return out + ["it's we'll " * 30, "!'s'" * 40 + "x" * 200, "a" + " " * 150 + "b" + "\n" * 150 + "c", "x'" * 90 + "ll" * 90]


@pytest.mark.parametrize("piece", [4, bpe.PIECE])
@pytest.mark.parametrize("size", [1, 3, 8, 40])
def test_leaves_equal_the_library(library, size, piece, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", piece)
    tool = bpe.codec(PATH)
    for text in texts():
        assert in_leaves(tool, text, size) == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_every_token_encodes_to_itself():
    tool = bpe.codec(PATH)
    assert all(tool.piece(letters) == [i] for i, letters in tool.letters.items())


def test_long_texts_are_halved_and_joined(library, monkeypatch):
    tool = bpe.codec(PATH)
    count, windows = [0], []
    join, piece = tool.join, tool.piece
    monkeypatch.setattr(tool, "join", lambda a, b: (count.__setitem__(0, count[0] + 1), join(a, b))[1])
    monkeypatch.setattr(tool, "piece", lambda letters: (windows.append(len(letters)), piece(letters))[1])
    text = "The cat's toys, 12 of them, aren't here.\n" * 2_000 + "abcde" * 20_000
    assert in_leaves(tool, text, bpe.LEAF) == library.encode(text, add_special_tokens=False).ids
    assert count[0] == len(list(tool.leaves(text))) - 1 > 20
    assert max(windows) <= bpe.PIECE  # no window grew to a whole leaf


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_query_equals_the_library(spark, library):
    rng = random.Random(2)
    long = ["".join(rng.choices("abcdehnorst", k=70_000)), "word " * 9_000, "x" * 40_000 + " <|endoftext|> " + "é1" * 9_000,
            "".join(rng.choices("abc ", k=50_000))]
    data = [None, *texts()[:40], *long, long[0]]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(data)],
                                 "doc_id long, text string, row string, ids int")
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_report(rows, PATH).collect()}
    assert found == {i: digests(library, t) for i, t in enumerate(data)}


def test_ids_and_columns(spark):
    rows = spark.createDataFrame([(1, "the cat", "k"), (1, "the cat", "k")], "doc_id long, text string, key string")
    out = bpe.encode_decode(rows, PATH).collect()
    assert [(r.row.key, r.bpe.ids, r.bpe.decoded) for r in out] == [("k", [1169, 3797], "the cat")] * 2


def test_invalid_bytes_decode_like_the_library(library):
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 12))]
        assert bpe.codec(PATH).decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_empty(spark):
    assert bpe.bpe_report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
