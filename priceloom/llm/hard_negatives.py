"""Hard-negative mining by slot-decomposed selection.

An anchor has a few positives: its best rows of the same label. Each positive opens a window of scores, from
half its score to just below it, and asks for the best rows of other labels inside. The windows overlap. Their
upper limits cut the scores into disjoint slots, so that a row counts once: a combiner keeps the first ``k`` rows
of every slot, block by block and then over all parts of the rows. The answer to a window is the merge, in descending order,
of the slots from its upper limit down, until ``k`` rows are found or its lower limit is passed.

Anchors are compared with all rows in pairs of bounded blocks, once to find positives and once to fill the
slots. All numbers are integers, so nothing depends on the order of additions.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceloom.llm.workspace import Shelf
from priceloom.operators.blocks import compare_blocks

POSITIVES = 5
NEGATIVES = 3
#: A window reaches from LOWER to UPPER hundredths of the positive's score.
LOWER, UPPER = 50, 95
#: Anchors whose scores a task computes at once.
ROWS_AT_ONCE = 256
#: Steps that a component's unit is cut into.
SCALE = 256

_LONG = (1 << 63) - 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices; beyond a long they stop at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = max(1, int(max(abs(int(a.min())), int(a.max())))) * max(1, int(max(abs(int(b.min())), int(b.max()))))
    if largest * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest * a.shape[1] < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _groups(table: pa.Table):
    """Row numbers and matrix per vector length, rows ascending by id, then by row key."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
    vectors = table.column("vector").chunk(0) if table.num_rows else None
    if vectors is None:
        return table, {}
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, values[starts[rows][:, None] + np.arange(n)].reshape(len(rows), n)
    return table, out


def _first(score: np.ndarray, allowed: np.ndarray, k: int):
    """Places ``(row, column)`` of the first ``k`` allowed columns of each row: higher scores first, then the order."""
    if score.shape[1] > k:
        masked = np.where(allowed, score, -_LONG - 1)
        least = np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        allowed = allowed & (score >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, ~score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _first_by_slot(table: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each anchor and slot: higher scores, then smaller ids, then smaller row keys."""
    names = [n for n in ("anchor", "slot") if n in table.column_names]
    keys = [table.column(n).to_numpy() for n in names]
    score, vec_id, row = (table.column(n).to_numpy() for n in ("score", "vec_id", "row"))
    order = np.lexsort((row, vec_id, ~score, *reversed(keys)))
    new = np.r_[True, np.any([np.diff(x[order]) != 0 for x in keys], axis=0)][:len(order)]
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return table.take(pa.array(order[place < k]))


def _compared(pick, names, k):
    """Compare two blocks: ``pick`` yields ``(slot, rows, columns)`` for scores of some anchors and all rows.

    Of these and the rows found before, the first ``k`` of each anchor and slot are kept.
    """

    def compare(anchors: pa.Table, rows: pa.Table, before: pa.Table | None) -> pa.Table:
        anchors, left = _groups(anchors)
        rows, right = _groups(rows)
        take = {n: anchors.column(n).to_numpy() for n in ("vec_id", "label", "row")}
        other = {n: rows.column(n).to_numpy() for n in ("vec_id", "label", "row")}
        out = [[] for _ in names]
        for length in left.keys() & right.keys():
            (own, a), (theirs, b) = left[length], right[length]
            for at in range(0, len(own), ROWS_AT_ONCE):
                some = own[at:at + ROWS_AT_ONCE]
                score = scores(a[at:at + ROWS_AT_ONCE], b)
                same = take["label"][some][:, None] == other["label"][theirs][None, :]
                apart = take["vec_id"][some][:, None] != other["vec_id"][theirs][None, :]
                for slot, i, j in pick(anchors, some, score, same, apart):
                    found = {"anchor": take["row"][some[i]], "slot": np.full(len(i), slot), "score": score[i, j],
                             "vec_id": other["vec_id"][theirs[j]], "row": other["row"][theirs[j]]}
                    for values, name in zip(out, names):
                        values.append(found[name])
        here = pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
                         for n, v in zip(names, out)})
        return here if before is None else _first_by_slot(pa.concat_tables([before, here]), k)

    return compare


def _same_label(k):
    def pick(anchors, some, score, same, apart):
        yield 0, *_first(score, same & apart, k)

    return pick


def _in_slots(k):
    def pick(anchors, some, score, same, apart):
        limits = anchors.column("limits").combine_chunks()
        counts = limits.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(counts)[:-1]][some]
        flat = limits.flatten().to_numpy(zero_copy_only=False)
        most = int(counts[some].max(initial=0))
        slot = np.zeros(score.shape, np.int64)
        for j in range(most):
            has = counts[some] > j
            limit = np.where(has, flat[np.minimum(starts + j, len(flat) - 1)], -_LONG - 1)
            slot += has[:, None] & (score <= limit[:, None])
        least = anchors.column("least").to_numpy()[some]
        open_ = ~same & (score >= least[:, None])
        for j in range(1, most + 1):
            yield j, *_first(score, open_ & (slot == j), k)

    return pick


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, vector, row)``: components as whole 256ths, and a key of the row.

    Rows take no part if id, label or vector is null, or any component null or not finite. Rows equal in id,
    label and vector are one row.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    kept = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    kept = kept.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       whole.alias("vector"))
    return kept.withColumn("row", F.xxhash64("vec_id", "label", "vector")).dropDuplicates(["vec_id", "label", "row"])


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` and ``anchors`` are made by ``quantised``. An anchor's positives are its first rows of the same
    label, its negatives of a positive the first rows of other labels whose score lies between ``lower`` and
    ``upper`` hundredths of the positive's, limits included. First means higher score, then smaller id, then
    smaller row key. Rows with the anchor's id and rows with vectors of another length are no partners. Anchors
    that share an id are answered one by one. Windows of negative scores are empty. Empty tables give no rows.
    """
    shelf = Shelf(rows.sparkSession)
    found = compare_blocks(anchors, rows, _compared(_same_label(positives), ("anchor", "vec_id", "row", "score"), positives),
                           "anchor long, vec_id long, row long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    floor = lambda p: F.floor(p.cast("decimal(38,0)") * upper / 100).cast("long")
    ceil = lambda p: F.ceil(p.cast("decimal(38,0)") * lower / 100).cast("long")
    windows = shelf.put("windows", found.select(
        "anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        ceil(F.col("score")).alias("from"), floor(F.col("score")).alias("to")).where("from <= to"))
    slots = windows.groupBy("anchor").agg(F.sort_array(F.collect_set("to"), asc=False).alias("limits"),
                                          F.min("from").alias("least"))
    asked = shelf.put("asked", anchors.join(slots, anchors["row"] == slots["anchor"]).drop("anchor"))

    filled = compare_blocks(asked, rows, _compared(_in_slots(negatives), ("anchor", "slot", "vec_id", "row", "score"), negatives),
                            "anchor long, slot long, vec_id long, row long, score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    filled = filled.withColumn("place", F.row_number().over(best)).where(F.col("place") <= negatives)
    # At most positives x negatives rows per anchor: slots in descending order are one descending list.
    order = F.struct((-F.col("slot")).alias("down"), "score", (-F.col("vec_id")).alias("id_down"),
                     F.bitwise_not("row").alias("row_down"), "vec_id")
    lists = filled.groupBy("anchor").agg(F.sort_array(F.collect_list(order), asc=False).alias("filled"))
    inside = F.filter("filled", lambda x: (x["score"] <= F.col("to")) & (x["score"] >= F.col("from")))
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    answered = windows.join(lists, "anchor").join(ids, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "negative"))
    return answered.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """The registered job: rows whose id 7 divides get the next label, rows whose id 50 divides are the anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = Shelf(embeddings.sparkSession).put("rows", quantised(embeddings.select("vec_id", "embedding", label.alias("label"))))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))
