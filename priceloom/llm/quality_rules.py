"""Quality rules: a table of thresholds compiled into Spark projections, without user functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words; a text in one of these languages holds many of them.
STOP_WORDS = {
    "en": "a an and are as at be by for from he in is it of on or re that the this to was with what".split(),
    "de": "auf das den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "es": "con de del el en es la las los no por que se su un una y".split(),
    "fr": "au dans de des du en est et la le les ou par pas pour que qui un une".split(),
}
SYMBOLS = "#*$%&|<>"

#: name, value of a text, least and largest value of a text that is kept (None: no bound).
RULES = [
    ("mean_word_chars", "word_chars / n_words", 2.0, 15.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.25),
    ("stop_word_ratio", "n_stop_words / n_words", 0.04, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("repeat_word_ratio", "n_repeat_words / n_words", None, 0.5),
]
MIN_WORDS = 50

_WORD = r"[^\x20\x09-\x0D]+"


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``counts``, a struct of the numbers that the rules compare, to every row.

    Words are runs without blanks (space and U+0009 to U+000D); a null text has none. Each step is a
    projection of its own, so nothing is computed twice, and no row leaves its task.
    """
    stops = sorted(set().union(*STOP_WORDS.values()))
    step = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    step = step.select(
        "_row", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)).alias("_words"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\f\r")) != "").alias("_lines"))
    step = step.select(
        "_row", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*stops))).cast("long").alias("n_stop_words"),
        F.expr("slice(transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))), 1, "
               "greatest(size(_words) - 2, 0))").alias("_windows"))
    kept = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    # Most texts repeat no window; only the others are sorted to find where equal windows stand.
    step = step.select("_row", *kept, F.expr(
        "if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h: bigint, i: int>>), "
        "sort_array(transform(_windows, (h, i) -> struct(h, i))))").alias("_sorted"))
    step = step.select("_row", *kept, F.expr(
        "sort_array(transform(filter(_sorted, (x, j) -> x.h <=> get(_sorted, j - 1).h or x.h <=> get(_sorted, j + 1).h)"
        ", x -> x.i))").alias("_again"))
    step = step.select("_row", *kept, F.expr(
        "aggregate(transform(_again, (p, j) -> least(3, coalesce(get(_again, j + 1), p + 3) - p)), 0L, (a, b) -> a + b)"
    ).alias("n_repeat_words"))
    return step.select(
        *[F.col("_row").getField(c).alias(c) for c in df.columns],
        F.struct(*kept, "n_repeat_words").alias("counts"))


def verdict(rules=RULES, min_words: int = MIN_WORDS) -> tuple[Column, Column]:
    """The rule table as two boolean columns over ``counts``: base check failed, and kept."""
    def number(name):
        return F.col("counts").getField(name)

    base_failed = (number("n_words") < min_words) | (100 * number("n_repeat_words") > 50 * number("n_words"))
    kept = ~base_failed
    for _, ratio, low, high in rules:
        above, below = ratio.split(" / ")
        value = F.try_divide(number(above).cast("double"), number(below).cast("double"))
        if low is not None:
            kept = kept & F.coalesce(value >= low, F.lit(False))
        if high is not None:
            kept = kept & F.coalesce(value <= high, F.lit(True))
    return base_failed, kept


def quality_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns of ``df`` and ``quality``: the counts, ``base_failed`` and ``kept`` in one struct.

    A null, empty or blank text has no words and fails the base check. A column named ``quality`` or
    ``counts`` in ``df`` is kept as it is, because the verdict is put beside a struct of the whole row:
    the result has the two columns ``row`` and ``quality``.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.col(f"`{text}`").alias("text"))
    base_failed, kept = verdict(rules)
    verdicts = F.struct("counts.*", base_failed.alias("base_failed"), kept.alias("kept"))
    # Out of a one-row generator: a filter on the verdict is not moved below the steps, which would repeat them all.
    return counts(packed).select("row", F.explode(F.array(verdicts)).alias("quality"))
