"""Merkle manifest of a table: a digest per row, one root, and for every row the proof that leads to it.

Rows of a group (a language) ascend by id; every ``FAN`` consecutive nodes become one, until one node is
left: the subroot. The subroots, in order of their group, are the leaves of a top tree, built alike.

Proofs are found by pointer jumping. A node knows an ancestor and the segments on the way to it: per level,
the digests left and right of the path. At first the ancestor is the parent. In each round every node joins
the row of its ancestor, takes over that row's ancestor and appends its segments, so the distance doubles and
the number of self-joins is the logarithm of the depth. All of it is SQL expressions; a run holds at most
``FAN`` digests, and nothing longer than a proof is ever gathered into one row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.llm.workspace import Shelf
from priceloom.operators.joins import lookup_join, with_scalars
from priceloom.operators.ordinal import with_ordinal

#: Children of a node, a power of two.
FAN = 8
#: Rows that may meet one ancestor in a join; beyond them the ancestor is copied and its rows are salted.
MEET = 256
_MOST_COPIES = 256

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = ("tree", "level", "place")
#: The tree over the subroots.
_TOP = -1

# What tampering changes.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """A value as UTF-8 byte count, colon and text; null is a hyphen, which no value can be."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """The digest of one row: 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _end_to_end(digests: Column) -> Column:
    return F.aggregate(digests, F.unhex(F.lit("")), lambda a, x: F.concat(a, x))


def _grow(shelf: Shelf, name: str, leaves: DataFrame, is_top: bool) -> tuple[list[DataFrame], DataFrame, int]:
    """Trees over ``leaves (tree, place, hash, size, top)``: ``size`` counts the nodes of a tree at this level,
    ``top`` is the place of its subroot in the top tree.

    Returns a table of edges per level, the last node ``(top, hash)`` of each tree, and the number of levels.
    """
    width = leaves.agg(F.max("size")).first()[0] or 0
    level, step, edges, last = leaves, 0, [], [leaves.where("size = 1")]
    while width > 1:
        kids = F.sort_array(F.collect_list(F.struct("place", "hash")))
        runs = (level.where("size > 1")
                .groupBy("tree", "size", "top", F.floor(F.col("place") / FAN).alias("parent")).agg(kids.alias("kids"))
                .withColumn("run", F.transform("kids", lambda k: k["hash"])))
        runs = shelf.put(f"{name}-{step}", runs)
        above = F.ceil(F.col("size") / FAN)
        # The last node of a tree is the leaf of the top tree at its place.
        moves = F.lit(not is_top) & (above == 1)
        kid = runs.select("tree", "size", "top", "parent", "run", F.posexplode("kids").alias("at", "kid"))
        segment = F.struct(_end_to_end(F.slice("run", F.lit(1), F.col("at"))).alias("left"),
                           _end_to_end(F.slice("run", F.col("at") + 2, F.lit(FAN))).alias("right"))
        edges.append(kid.select(
            "tree", F.lit(step).alias("level"), F.col("kid.place").alias("place"),
            F.when(moves, F.lit(_TOP).cast("long")).otherwise(F.col("tree")).alias("up_tree"),
            F.when(moves, 0).otherwise(step + 1).alias("up_level"),
            F.when(moves, F.col("top")).otherwise(F.col("parent")).alias("up_place"),
            F.array(segment).alias("segments")))
        texts = F.aggregate("run", F.lit(""), lambda a, x: F.concat(a, _text(x)))
        level = runs.select("tree", F.col("parent").alias("place"), F.unhex(F.sha2(texts, 256)).alias("hash"),
                            above.alias("size"), "top")
        last.append(level.where("size = 1"))
        width, step = -(-width // FAN), step + 1
    return edges, reduce(DataFrame.unionByName, last).select("top", "hash"), step


def _jumped(shelf: Shelf, edges: list[DataFrame], depth: int) -> DataFrame:
    """Double the distance of every node to its known ancestor until all know the root."""
    known = shelf.put("known-1", reduce(DataFrame.unionByName, edges))
    distance = 1
    while distance < depth:
        copies = min(max(1, FAN ** distance // MEET), _MOST_COPIES)
        # A node of a lower level is no ancestor at this distance.
        over = known.where((F.col("level") >= distance) | (F.col("tree") == _TOP)).select(
            *[F.col(c).alias(f"over_{c}") for c in known.columns],
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        salt = F.pmod(F.xxhash64(*_NODE), F.lit(copies)).cast("int")
        meets = [F.col(f"up_{c}") == F.col(f"over_{c}") for c in _NODE]
        joined = known.withColumn("salt", salt).join(over, [*meets, F.col("salt") == F.col("copy")], "left")
        further = F.col("over_tree").isNotNull()
        jumped = joined.select(
            *_NODE, *[F.when(further, F.col(f"over_up_{c}")).otherwise(F.col(f"up_{c}")).alias(f"up_{c}") for c in _NODE],
            F.when(further, F.concat("segments", "over_segments")).otherwise(F.col("segments")).alias("segments"))
        known = shelf.put(f"known-{2 * distance}", jumped)
        shelf.drop(f"known-{distance}")
        distance *= 2
    return known


def proofs(docs: DataFrame, shown: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id",
           group: str = "lang") -> DataFrame:
    """``(key, leaf, shown, subroot, root, segments)`` for every row of ``docs``; digests are 32 bytes.

    ``segments`` holds, from the leaf to the root, one ``(left, right)`` per level: the digests of the run's
    others before and after the path, end to end. ``shown`` is a digest that is carried along to be checked,
    the row's own by default. Groups and ids are ordered with null first, text bytewise; rows that repeat an id
    follow in the order of their digests, and rows equal in all fields have leaves of their own, one beside the
    other. A group of one row has no level of its own, a single group none above it. An empty table gives no
    rows. Columns that are not among ``fields`` are not read.
    """
    shelf = Shelf(docs.sparkSession)
    leaf = row_digest(*[F.col(c) for c in fields])
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("hash"),
                       (leaf if shown is None else shown).alias("shown"))
    numbered = with_ordinal(rows, [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "hash"], "row_id")
    groups = numbered.groupBy("group").agg(F.count("*").alias("size"), F.min("row_id").alias("tree"))
    groups = with_ordinal(groups, ["tree"], "top")
    leaves = shelf.put("leaves", lookup_join(numbered, groups, ["group"], salt_on=["row_id"]).select(
        "key", "hash", "shown", "tree", (F.col("row_id") - F.col("tree")).alias("place"), "size", "top"))

    low, subroots, levels = _grow(shelf, "group", leaves.select("tree", "place", "hash", "size", "top"), False)
    subroots = shelf.put("subroots", subroots)
    tops = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("top").alias("place"), "hash",
                           F.lit(subroots.count()).cast("long").alias("size"), F.lit(0).cast("long").alias("top"))
    high, root, more = _grow(shelf, "top", tops, True)

    alone = F.col("size") == 1
    ends = leaves.select(
        "key", "hash", "shown", "top", F.when(alone, F.lit(_TOP).cast("long")).otherwise(F.col("tree")).alias("tree"),
        F.lit(0).alias("level"), F.when(alone, F.col("top")).otherwise(F.col("place")).alias("place"))
    empty = F.lit([]).cast("array<struct<left:binary,right:binary>>")
    if low or high:
        known = _jumped(shelf, low + high, levels + more).select(*_NODE, "segments")
        ends = ends.join(known, list(_NODE), "left").withColumn("segments", F.coalesce("segments", empty))
    else:
        ends = ends.withColumn("segments", empty)
    ends = lookup_join(ends, subroots.withColumnRenamed("hash", "subroot"), ["top"], salt_on=["hash", "place"])
    ends = with_scalars(ends, root.select(F.col("hash").alias("root")))
    return ends.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "shown", "subroot", "root", "segments")


def folded(start: Column, segments: Column) -> Column:
    """The root, in hex, that a digest and its segments lead to."""
    return F.aggregate(segments, _text(start), lambda a, s: F.sha2(F.concat(_text(s["left"]), a, _text(s["right"])), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof digest per row, and what the proof says about a tampered copy of the row.

    The copy's text has its letters A to Z in lower case where 3 divides the crc32 of the id; a null id is
    never tampered with, and a null text cannot be.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = row_digest(*[F.translate("text", _UPPER, _UPPER.lower()) if c == "text" else F.col(c) for c in FIELDS])
    shown = F.when(tampered, changed).otherwise(row_digest(*[F.col(c) for c in FIELDS]))
    siblings = F.aggregate("segments", F.lit(""), lambda a, s: F.concat(a, _text(s["left"]), _text(s["right"])))
    found = proofs(docs, shown).withColumn("folded_root", folded(F.col("shown"), F.col("segments")))
    return found.select("doc_id", _text(F.col("leaf")).alias("leaf"), _text(F.col("subroot")).alias("subroot"),
                        _text(F.col("root")).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == _text(F.col("root"))).alias("verified"))
