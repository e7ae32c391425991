import random

import public_tokenizers
import pytest
import sentencepiece

from priceloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(8)
    words = ["the", "of", "tion", "ing", "", "", "\n", "\t", "é", "你好", "𝒳", "▁", "<s>", "</s>", "<unk>", "<0x41>", "x" * 30, "12",
             "　", "\x00"]
    out = ["", " ", "  ", "\n", "a", " a ", "a" * 500, "▁" * 40, " " * 300, "ab " * 100, "é" * 90]
    for _ in range(150):
        out.append(" ".join(rng.choices(words, k=rng.randrange(120))))
        out.append("".join(rng.choices([*words, " "], k=rng.randrange(120))))
        out.append("".join(rng.choices("ab ", weights=(9, 9, 1), k=rng.randrange(400))))
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(5, 1), (20, 8), (100, 4), (2048, 64)])
def test_counts_equal_the_library(library, chunk, overlap):
    data = texts()
    tool = token_counts.Counter(PATH, chunk, overlap)
    assert tool.splits
    assert tool.counts(data) == [len(x) for x in library.encode(data)]


def test_query(spark, library):
    rng = random.Random(3)
    data = [None, *texts()[:30], "".join(rng.choices("abcde   \n", k=90_000)), "q" * 9_000, "word " * 5_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(data)], "doc_id long, text string, row string")
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_report(rows, PATH).collect()}
    sizes = [len(library.encode(t or "")) for t in data]
    assert found == {i: (len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(data, sizes))}


def test_only_a_text_column_and_empty(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    assert sorted(r.n_tokens for r in token_counts.count_tokens(rows, PATH).collect()) == [0, 2]
    assert token_counts.token_report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
