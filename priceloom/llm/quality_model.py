"""Quality classifier: naive Bayes support vectors.

A text is a set of hashed n-grams: of bytes, and of word shapes (case, symbols, length, whether the word
repeats the one before). Class counts of every n-gram are taken over all labelled learning documents;
their log-ratios scale the indicators. On the scaled, normalised vectors of a bounded sample, a
linear hinge-loss model is fitted by dual coordinate descent, and a logistic curve turns margins into
scores. Model and sample have fixed sizes: buckets, and sample rows x buckets bits.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.llm.arrays import PrefixHash, flat, mix, slices, words
from priceloom.llm.split import held_out, remainder
from priceloom.session import checkpointed

BUCKETS = 1 << 16
#: Labelled rows that the linear model is fitted on, half of each class; chosen by the hash of the id.
SAMPLE = 4000
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # of bytes: lower, upper, digit, symbol, beyond ASCII
_KIND[:] = 3
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 4


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x + _U(kind * 0x51ED2701)) >> _U(48)).astype(np.int64)


def features(column) -> list[np.ndarray]:
    """For each text of an Arrow column the buckets of its n-grams, repeats included."""
    data, offsets = flat(column)
    grams = [np.zeros(0, np.int64)] * 2
    for i, size in enumerate((2, 3)):
        packed = np.zeros(max(0, len(data) - size + 1), np.uint64)
        for j in range(size):
            packed = packed << _U(8) | data[j:j + len(packed)]
        grams[i] = _bucket(packed, size)
    begin, end, first = words(data, offsets)
    shapes = []
    if len(begin):
        hashes = PrefixHash(data).of(begin, end)
        kinds = np.cumsum(np.vstack([np.zeros((1, 5), np.int32), np.eye(5, dtype=np.int32)[_KIND[data]]]), axis=0) \
            if len(data) else np.zeros((1, 5), np.int32)
        share = kinds[end] - kinds[begin]
        length = end - begin
        part = np.minimum(2, share * 3 // np.maximum(1, length)[:, None])  # none or few, some, most
        same = np.r_[False, hashes[1:] == hashes[:-1]]
        opens = _KIND[data[begin]]
        closes = np.where(_KIND[data[end - 1]] == 3, data[end - 1], 0).astype(np.int64)
        shape = np.minimum(length // 4, 5).astype(np.int64)
        for extra, base in ((part[:, 1], 3), (part[:, 3], 3), (same, 2), (opens, 5), (closes, 256)):
            shape = shape * base + extra
        shape = mix(shape.astype(np.uint64))
        for size in (1, 2, 3):
            chain = np.zeros(max(0, len(shape) - size + 1), np.uint64)
            for j in range(size):
                chain = chain * _U(0x9E3779B97F4A7C15) + shape[j:j + len(chain)]
            shapes.append(_bucket(chain, 10 + size))
    out = []
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        parts = [g[a:max(a, b - size + 1)] for g, size in zip(grams, (2, 3))]
        for size, g in enumerate(shapes, 1):
            parts.append(g[first[i]:max(first[i], first[i + 1] - size + 1)])
        out.append(np.concatenate(parts))
    return out


def _learned(batches):
    """Class counts of every n-gram as rows of their own, and the sampled documents as packed indicators."""
    counts = np.zeros((2, BUCKETS), np.int64)
    flags = np.zeros(BUCKETS, bool)
    for batch in batches:
        for part in slices(batch, "text"):
            labels = part.column("label").to_pylist()
            picked = part.column("picked").to_pylist()
            order = part.column("place").to_pylist()
            sample = []
            for buckets, label, chosen, place in zip(features(part.column("text")), labels, picked, order):
                flags[buckets] = True
                counts[label] += flags
                if chosen:
                    sample.append((label, place, zlib.compress(np.packbits(flags).tobytes(), 1)))
                flags[:] = False
            if sample:
                label, place, bits = zip(*sample)
                yield _rows(label, [None] * len(label), [None] * len(label), place, bits)
    label, bucket = np.nonzero(counts)
    if len(label):
        none = [None] * len(label)
        yield _rows(label, bucket, counts[label, bucket], none, none)


def _rows(*columns):
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["label", "bucket", "n", "place", "bits"])


def descend(rows: list[np.ndarray], target: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS):
    """Dual coordinate descent for the hinge loss; ``rows`` hold the buckets that are set, ``cost`` bounds each dual."""
    weights = np.zeros(len(scale) + 1)  # the last one is the bias
    vectors = []
    for r in rows:
        values = scale[r]
        vectors.append((np.r_[r, len(scale)], np.r_[values / max(1e-12, np.sqrt(values @ values)), 1.0]))
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = vectors[i]
            slope = target[i] * (weights[at] @ x) - 1
            step = min(max(dual[i] - slope / (x @ x), 0.0), cost[i]) - dual[i]
            if step:
                dual[i] += step
                weights[at] += step * target[i] * x
    return weights


def margins(rows: list[np.ndarray], scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, r in enumerate(rows):
        values = scale[r]
        out[i] = (weights[r] @ values) / max(1e-12, np.sqrt(values @ values)) + weights[-1]
    return out


def _curve(margin: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed targets."""
    n1, n0 = label.sum(), (~label).sum()
    goal = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * margin).sum() + 1e-6 * a, (p - goal).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit(learning: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from ``(doc_id, text, label)``: scale and weights per bucket and the curve; a constant if a class is missing.

    Counts cover all rows; the sample holds at most ``sample // 2`` rows of each class, those whose ids have
    the smallest hashes. Null labels are left out.
    """
    learning = learning.where("label is not null")
    sizes = {r.label: r.n for r in learning.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return {"constant": positive / (positive + negative) if positive + negative else 0.5}
    place = F.xxhash64("doc_id")
    # A little more than wanted passes this test; the exact bound follows below.
    edges = {c: int(min(1.0, 1.2 * (sample // 2 + 50) / n) * 2**32) for c, n in ((0, negative), (1, positive))}
    below = F.when(F.col("label") == 1, F.lit(edges[1])).otherwise(F.lit(edges[0]))
    found = checkpointed(
        learning.select("text", "label", place.alias("place"), (place.bitwiseAND(F.lit(2**32 - 1)) <= below).alias("picked"))
        .mapInArrow(_learned, "label int, bucket int, n long, place long, bits binary"))
    counts = found.where("bucket is not null").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, BUCKETS))
    table[counts["label"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    table += SMOOTHING
    scale = np.log(table[1] / (positive + 2 * SMOOTHING)) - np.log(table[0] / (negative + 2 * SMOOTHING))
    picked = []
    for c in (0, 1):
        part = found.where((F.col("bits").isNotNull()) & (F.col("label") == c))
        picked += part.orderBy(F.col("place").bitwiseAND(F.lit(2**32 - 1)), "place", "bits").limit(sample // 2).select("label", "place", "bits").collect()
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r.bits), np.uint8))) for r in picked]
    label = np.array([r.label == 1 for r in picked])
    folds = np.array([r.place % 5 == 0 for r in picked])  # a fifth for the curve
    if not all((label & f).any() and (~label & f).any() for f in (folds, ~folds)):
        folds = np.zeros(len(rows), bool)
    train = np.flatnonzero(~folds)
    cost = PENALTY * np.where(label, len(rows) / (2 * label.sum()), len(rows) / (2 * (~label).sum()))
    weights = descend([rows[i] for i in train], np.where(label, 1.0, -1.0)[train], scale, cost[train])
    check = np.flatnonzero(folds) if folds.any() else train
    margin = margins([rows[i] for i in check], scale, weights)
    share = positive / (positive + negative)
    slope, offset = _curve(margin, label[check])
    half = label[check].mean()
    offset += np.log(share / (1 - share)) - np.log(half / (1 - half))  # the sample is balanced, documents are not
    return {"scale": scale.astype(np.float32), "weights": weights.astype(np.float32), "slope": slope, "offset": offset}


def _scored(model):
    def rows(batches):
        flags = np.zeros(BUCKETS, bool)
        for batch in batches:
            for part in slices(batch, "text"):
                if "constant" in model:
                    score = np.full(part.num_rows, model["constant"])
                else:
                    sets = []
                    for buckets in features(part.column("text")):
                        flags[buckets] = True
                        sets.append(np.flatnonzero(flags))
                        flags[sets[-1]] = False
                    odds = model["slope"] * margins(sets, model["scale"], model["weights"]) + model["offset"]
                    score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score)], ["row", "score"])

    return rows


def score_quality(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``df`` but the text) and ``score`` (0 to 1) of every text; a null text counts as empty."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = df.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    return packed.mapInArrow(_scored(model), f"row {packed.schema['row'].dataType.simpleString()}, score double")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from labelled documents that are not held out, then score every row of ``(doc_id, text)``.

    Repeated ids on both sides learn once per pair of rows; conflicting labels are all counted.
    """
    # Labels grow with the documents: the same shuffled join at every size, never a broadcast.
    learning = docs.where(remainder() != 2).select("doc_id", "text").hint("merge").join(
        labels.where("quality in (0, 1)").where(remainder() != 2)
        .select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    model = fit(learning)
    scored = score_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("row.doc_id", "row.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
