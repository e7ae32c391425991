"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket are taken over all learning documents, added up by Spark, and become a
matrix of log-probabilities of fixed size (buckets x languages) that travels to every task. Tasks
score slices of documents at once with numpy.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.llm.arrays import slices
from priceloom.llm.split import held_out, remainder

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"

_U = np.uint32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (one row per n-gram size) for every character, where each text begins, and its number of letters.

    Letters are in lower case, everything else is a space. Two spaces stand before and after each text, so
    that no n-gram of a text holds letters of another.
    """
    lowered = [(t or "").lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 4 for t in lowered)])
    codes = np.frombuffer(("".join(f"  {t}  " for t in lowered) + "  ").encode("utf-32-le"), _U)
    letter = _letters()[codes]
    codes = np.where(letter, codes, _U(32))
    n = int(starts[-1])
    hashes, value = [], np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for size in range(1, max(SIZES) + 1):
            value = (value ^ codes[size - 1:size - 1 + n]) * _U(0x9E3779B1)
            value = value ^ (value >> _U(15))
            if size in SIZES:
                hashes.append((value * _U(0x85EBCA6B) + _U(size)) >> _U(32 - (BUCKETS.bit_length() - 1)))
    counts = np.add.reduceat(letter[:n].astype(np.int64), starts[:-1]) if len(texts) else np.zeros(0, np.int64)
    return np.stack(hashes), starts[:-1], counts


def _counted(langs):
    place = {name: i for i, name in enumerate(langs)}

    def rows(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, starts, _ = grams(part.column("text").to_pylist())
                owner = np.array([place[x] for x in part.column("lang").to_pylist()])
                each = np.repeat(owner, np.diff(np.r_[starts, buckets.shape[1]]))
                for row in buckets:
                    total += np.bincount(each * BUCKETS + row, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        if len(lang):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
                ["lang", "bucket", "n"])

    return rows


def fit(learning: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (languages x buckets) and log-priors from ``(text, lang)``.

    The matrix is bounded by the number of buckets and of labels; only it reaches the driver.
    """
    learning = learning.where("lang is not null and text is not null")
    documents = {r.lang: r.n for r in learning.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(documents)
    if not langs:
        return [], np.zeros((0, BUCKETS)), np.zeros(0)
    counts = (learning.select("text", "lang").mapInArrow(_counted(langs), "lang int, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    total = np.full((len(langs), BUCKETS), SMOOTHING)
    np.add.at(total, (counts["lang"].to_numpy(), counts["bucket"].to_numpy()), counts["n"].to_numpy())
    prior = np.array([documents[x] for x in langs], float)
    return langs, np.log(total / total.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())


def _scored(langs, matrix, prior):
    def rows(batches):
        table = np.asarray(matrix, np.float64)
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, starts, letters = grams(part.column("text").to_pylist())
                odds = np.stack([prior[i] + sum(np.add.reduceat(table[i][row], starts) for row in buckets)
                                 for i in range(len(langs))]) if langs else np.zeros((1, part.num_rows))
                best = odds.argmax(axis=0)  # the first of equals, in alphabetical order
                share = 1 / np.exp(odds - odds.max(axis=0)).sum(axis=0)
                known = (letters > 0) & bool(langs)
                names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))],
                    ["row", "lang_pred", "score"])

    return rows


def identify(df: DataFrame, model, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``df`` but the text), ``lang_pred`` and ``score`` (probability of it, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = df.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    langs, matrix, prior = model
    return packed.mapInArrow(_scored(langs, matrix.astype(np.float32), prior),
                             f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict every row of ``(doc_id, text, lang)``."""
    model = fit(docs.where(remainder() != 2).select("text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "row.doc_id", "row.held_out", "lang_pred", "score")
