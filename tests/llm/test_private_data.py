import hashlib
import random

import brute

from priceloom.llm import private_data

TEXTS = [
    None, "", "no data here", "mail a@b.com, c.d@e-f.co.uk", "a@b.c_d@e.f x@y", "x@y.z.@q.r", "1.2.3.4.5.6.7.8",
    "255.255.255.255 256.1.1.1 001.02.3.4 1.2.3", "999999999999999999999.1.1.1 0000000000000000000000000000001.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 4111111111111111", "1 2-3  4", "1234567890" * 200,
    "+1 (743) 555-3824 or +49.30.1234567", "+1+2+3", "+1 2", "é ñ 𝒳 a@b.com 𝒳 10.0.0.1", "a." * 3000 + "a@b" + ".c" * 3000,
    "x" * 5000 + "@", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" end', "call (212) 555-0199 now",
    "version 12345678901234567890ab see", "first.last_name-with_many-parts_1 here",
]


def documents():
    rng = random.Random(4)
    pieces = ["a@b.co", "1.2.3.4", "4111111111111111", "+1 (743) 555-3824", ".", " ", "-", "9", "@", "x", "é", "(", "+4"]
    return TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(25))) for _ in range(150)]


def test_base_spans_against_plain_patterns(spark):
    texts = documents()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for row in private_data.private_report(rows).collect():
        spans = brute.base_spans(texts[row.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), texts[row.doc_id]
        assert row.spans.startswith(written)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(s[0] == k for s in spans) for k in private_data.BASE]


def test_mask(spark):
    rows = spark.createDataFrame(
        [(1, "write to a@b.com or 10.0.0.1.", "k"), (2, None, None), (3, "nothing", "k"), (4, "é+1 (743) 555-3824", "k")],
        "doc_id long, text string, row string")
    texts = {r.doc_id: r.text for r in private_data.mask_private(rows).collect()}
    assert texts == {1: "write to <email> or <ip>.", 2: None, 3: "nothing", 4: "é<phone>"}
    assert private_data.mask_private(rows).columns == rows.columns


def test_overlapping_spans_are_masked_once(spark):
    text = "x 4111 1111 1111 1111@b.com y"
    row = private_data.mask_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == "x <card>@b.com y" or row.text == "x <card> y"


def test_labelers_learn_from_agreement():
    names = ["kind", *private_data.LABELERS, *private_data.FEATURES]

    def pattern(count, **given):
        return dict.fromkeys(names, 0) | {"kind": 5, "count": count} | given

    table = [pattern(900, cue=1, shape=1, quoted=1), pattern(40, cue=1, quoted=1), pattern(60, shape=1),
             pattern(300, shape=-1), pattern(200, shape=-1, against=-1), pattern(5, against=-1)]
    accuracy, share, belief = private_data.reliabilities(table)
    assert belief[0] > 0.9 and belief[4] < 0.1 and all(0.5 < a < 1 for a in accuracy.values()) and 0 < share[5] < 1
    weights = private_data.fit_classifier(table)
    odds = [sum(w * x for w, x in zip(weights, private_data._inputs(p))) for p in table]
    assert odds[0] > 0 > odds[4]


def test_secrets_follow_the_votes(spark):
    hexes = ["%040x" % random.Random(i).getrandbits(160) for i in range(30)]
    texts = [f'some words token = "{h}" more' for h in hexes] + [f"see page_{i}_of_the_long_name_{i} there" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in private_data.private_report(rows).collect()}
    assert all(found[i].startswith("secret:") for i in range(30)) and not any(found[i] for i in range(30, 60))


def test_empty(spark):
    assert private_data.private_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_secrets(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    tokens = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(20)]
    tokens += ["".join(rng.choices(letters + "0123456789", k=n)) + "7" for n in (255, 256, 257, 300, 1000, 5000)]
    tokens += ["".join(rng.choices(letters, k=n)) + "7" for n in (64, 65, 100, 300)]
    tokens.append("a" * 300_000 + "7" + "b" * 300_000)
    texts = [f'some words token = "{t}" more' for t in tokens] + ["a" * 600_000, "a" * 18 + "7", "-" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    secret = private_data.KINDS.index("secret")
    spans = {r.row.doc_id: [(x.start, x.end) for x in r.spans if x.kind == secret]
             for r in private_data.proposals(rows).collect()}
    assert [spans[i] for i in range(len(texts))] == [[(20, 20 + len(t))] for t in tokens] + [[], [], []]
    masked = {r.doc_id: r.text for r in private_data.mask_private(rows).collect()}
    assert all(masked[i] == 'some words token = "<secret>" more' for i in range(len(tokens)))
