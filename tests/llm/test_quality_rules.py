import random
import re

from priceloom.llm import quality_rules as q


def numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, t in enumerate(threes) if threes.count(t) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum((text or "").count(c) for c in q.SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)),
            "n_lines": len(lines), "n_repeat_words": len(covered),
            "n_stop_words": sum(w.lower() in set().union(*q.STOP_WORDS.values()) for w in words)}


def texts():
    rng = random.Random(2)
    out = [None, "", " \t\n\x0b\f\r", "a", "a b", "a b c", "a b c a b c", "a a a a a", "é 𝒳 ñ|#", "x\n\nx\n x\n\x0b\nx", "   "]
    for _ in range(80):
        out.append("".join(rng.choices(["the ", "of ", "a ", "b ", "\n", "\t", "|", "<&", "é", "word "], k=rng.randrange(150))))
    return out


def test_counts_and_verdict(spark):
    data = texts()
    rows = spark.createDataFrame([(i, t, "c", "k") for i, t in enumerate(data)],
                                 "doc_id long, text string, counts string, quality string")
    found = q.quality_rules(rows).collect()
    assert len(found) == len(data) and all(r.row.counts == "c" and r.row.quality == "k" for r in found)
    for r in found:
        n = numbers(data[r.row.doc_id])
        assert {k: getattr(r.quality, k) for k in n} == n, data[r.row.doc_id]
        failed = n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
        kept = not failed
        for _, ratio, low, high in q.RULES:
            above, below = ratio.split(" / ")
            kept = kept and (low is None or n[above] / n[below] >= low) and (high is None or n[above] / n[below] <= high)
        assert (r.quality.base_failed, r.quality.kept) == (failed, kept)


def test_a_filter_does_not_repeat_the_steps(spark):
    rows = spark.createDataFrame([(1, "the word " * 60)], "doc_id long, text string")
    plan = q.quality_rules(rows).where("quality.kept").select("row.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


def test_empty(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
