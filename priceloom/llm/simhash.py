"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check.

A 64-bit fingerprint is cut into segments, and the number of set bits of each segment makes a
vector of small counts. Flipping a bit moves one count by one, so the Manhattan distance of two
vectors never exceeds the Hamming distance of their fingerprints: it is a lower bound.

The range join looks for vectors within ``radius`` under Manhattan distance. The segments are dealt
into ``radius + shared`` groups; a distance of at most ``radius`` leaves at least ``shared`` groups
without any difference, so both vectors fall into the same cell of one of the grids that such
combinations of groups span. More shared groups give more grids of smaller cells; their number follows
from the count of fingerprints, and every choice finds the same links. Fingerprints of a cell meet in one task, are ruled out by the
Manhattan distance, then verified exactly. A cell of many fingerprints is cut into tiles, and pairs
of tiles into tasks. A task emits a star per component of the links it found, never the pairs.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.arrays import slices
from priceloom.llm.components import connected_components, contract
from priceloom.llm.workspace import text_batches
from priceloom.session import checkpointed

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Groups that must agree in a cell: the range that ``shared_groups`` chooses from.
SHARED = range(3, 9)
#: Comparisons in a cell that cost as much as one row of a grid.
COMPARISONS = 200
#: Fingerprints in a tile of a large cell.
TILE = 1024

_SEGMENTS = 32  # of two bits each
_EVEN = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS, chunk: int = 1 << 16) -> int:
    """SimHash of the word shingles of a text, with ASCII letters in lower case; zero without a word."""
    parts = raw.lower().split()
    if not parts:
        return 0
    size = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begin = np.r_[0, ends[:-1] + 1][:len(parts) - size + 1].tolist()
    end = ends[size - 1:].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), chunk):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at:at + chunk], end[at:at + chunk])],
                          np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begin), bitorder="little").view(np.int64)[0])


def _fingerprints(words):
    def rows(batches):
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words)
                                                   for t in texts], pa.int64())], ["doc_id", "fp"])

    return rows


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the unsigned fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """The counts of 32 segments of two bits, packed into a long."""
    above = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(above).bitwiseAND(F.lit(_EVEN))
    return one.bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(F.lit(_EVEN)), 1))


def _masks(radius: int, shared: int) -> list[int]:
    groups = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(_SEGMENTS), radius + shared)]
    return [_signed(sum(chosen)) for chosen in combinations(groups, shared)]


def shared_groups(count: int, radius: int) -> int:
    """The number of agreeing groups that costs least for ``count`` random fingerprints.

    Each is a row in every grid and is compared with the others of its cell. Two random segments have equally
    many bits set in 3 of 8 cases.
    """
    def cost(shared):
        return comb(radius + shared, shared) * (COMPARISONS + count * 0.375 ** (_SEGMENTS * shared / (radius + shared)))

    return min(SHARED, key=cost)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings. Counts are 0, 1 or 2, so a difference of two shows as binary 10."""
    even = np.uint64(_EVEN)
    differ = x ^ y
    odd, high = differ & even, (differ >> np.uint64(1)) & even
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def _embedded(x: np.ndarray) -> np.ndarray:
    return x - ((x >> np.uint64(1)) & np.uint64(_EVEN))


def _stars(unit: np.ndarray, fp: np.ndarray, radius: int):
    """Stars of the components of all links inside equal ``unit`` values, which are sorted."""
    vector = _embedded(fp)
    left, right = [], []
    at = np.arange(len(fp))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[unit[at] == unit[at + step]]
        near = at[manhattan(vector[at], vector[at + step]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        left.append(near)
        right.append(near + step)
    left, right = np.concatenate(left or [at]), np.concatenate(right or [at])
    nodes, index = np.unique(fp, return_inverse=True)
    label = contract(index[left], index[right], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _linked(radius):
    def rows(batches):
        unit, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(n):
            a, b = _stars(unit[:n], fp[:n], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            unit = np.concatenate([unit, batch.column("unit").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
            if whole:
                yield emit(whole)
                unit, fp = unit[whole:], fp[whole:]
        if len(unit):
            yield emit(len(unit))

    return rows


def links(distinct: DataFrame, radius: int = RADIUS, shared: int | None = None, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all fingerprints ``fp`` within ``radius`` bits.

    ``shared`` is chosen by the number of fingerprints if it is not given.
    """
    # A fingerprint is few bytes but becomes a row in every grid, so they are dealt to all tasks beforehand.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = checkpointed(distinct.select("fp").repartition(tasks, "fp"))
    shared = shared or shared_groups(distinct.count(), radius)
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell"))
                      for i, m in enumerate(_masks(radius, shared))])
    cells = distinct.select("fp", embedding(F.col("fp")).alias("counts")).select("fp", F.inline(grids))
    # Only cells over a tile need a count; there are at most grids x fingerprints / tile of them.
    large = checkpointed(cells.groupBy("grid", "cell").count().where(F.col("count") > tile))
    members = (cells.join(large, ["grid", "cell"], "left")
               .withColumn("tiles", F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int"))
               .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    units = members.select(F.xxhash64("grid", "cell", F.least("tile", "other"), F.greatest("tile", "other"))
                           .alias("unit"), "fp")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_linked(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``(doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; a component is all that links reach, and its
    id the smallest ``doc_id`` in it. A null or empty text has the fingerprint zero and links like any
    other. Rows that repeat a ``doc_id`` are rows of their own. Null ids are passed over when the
    smallest is sought (the component id is null if there is no other). An empty table gives no rows.
    """
    with text_batches(docs.sparkSession):
        marked = checkpointed(fingerprints(docs, words))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = checkpointed(grouped.join(smallest, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                             "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that tells nulls apart. Nested values are hashed as JSON, which keeps theirs."""
    parts = []
    for field in docs.schema:
        value = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts += [value.isNull(), F.to_json(F.struct(value)) if nested else value]
    return F.xxhash64(*parts)


def without_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest ``doc_id``, then the smallest text hash.

    Rows that agree in both are one document and stay once: the one whose columns have the smallest hash. A row
    without an id stays only if no other row of its component has one.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _row_hash(docs).alias("row_hash"))
    columns = docs.columns
    named = docs.select(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    with text_batches(docs.sparkSession):
        marked = checkpointed(fingerprints(named.select(F.col("place").alias("doc_id"),
                                                        F.col("row.text").alias("text")), words))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("place"))
    roots = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    kept = (distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("place").alias("place")))
    keys = [F.xxhash64("place").alias("place_hash"), F.col("place.row_hash").alias("row_hash")]
    kept = checkpointed(kept.select(*keys, F.col("place").alias("kept_place")))
    # What is left of a place are equal rows. They are grouped by the keys of the join, so that whole texts
    # are shuffled and sorted once.
    rows = named.select(*keys, "place", "row").join(kept, ["place_hash", "row_hash"]).where("place <=> kept_place")
    return rows.groupBy("place_hash", "row_hash").agg(F.first("row").alias("row")).select("row.*")
