"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A text is the set of its word shingles. Texts with equal sets are one set, and the join runs over distinct sets.

*Small sets* (up to a boundary size). Two sets of ``s`` and ``t`` shingles link when they share at least
``o(s, t)``. Each set lists, for every pair of sizes it can be part of, all its subsets of that fixed size:
sets that list the same subset link, and nothing has to be verified. Subsets are formed by what they leave out,
which is little.

*Large sets* scan inverted lists. Shingles have one order over the whole corpus, light ones before heavy ones
by counts of all occurrences. Linked sets share one of the first ``s - ceil(share * s) + 1`` shingles, so only these are
indexed, and heavy ones hardly ever are. A list with two members or more gives candidates: sets of suitable sizes
whose sketches (counts of shingles by hash bucket) differ no more than linked sets may. The sketch distance
never exceeds the number of shingles that are in one set only, so no link is lost. Components of candidates are
then compared shingle by shingle.

The boundary is the size at which the measured sum of subsets and list entries over all sets is least.

Neither lists nor components are expanded into pairs. Members of a component are taken up one by one, each being
compared with those that no link has reached yet: in a group of copies that is one pass. A large component is
dealt into tiles that all see the component's first set; what it does not reach meets the tiles again.
"""

import re
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.llm.arrays import mix
from priceloom.llm.components import connected_components
from priceloom.llm.workspace import Shelf

WORDS = 3
#: Hundredths of the union that linked sets share at least.
SHARE = 90
#: Sizes that are considered for the boundary.
MOST_SMALL = 48
#: Rows that an entry of an inverted list costs in shuffles; a subset costs two.
ENTRY_COST = 3
#: Members of a list that are compared by sketches; a longer list is one candidate group.
LIST_MEMBERS = 4096
#: Shingles of a component that a tile holds.
TILE_SHINGLES = 1 << 17

_U = np.uint64
_BUCKET_BITS = 20
_BLOCK = 4096
_CHUNK = 1 << 20
_CACHE = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def needed(s: int, t: int, share: int = SHARE) -> int:
    """Shingles that sets of two sizes must share to link."""
    return -(-share * (s + t) // (100 + share))


def least_overlap(s, share: int = SHARE):
    return -(-share * s // 100)


class Shingles:
    """Turn texts into sorted arrays of distinct 64-bit shingle hashes. Word hashes are kept between texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def hashes(self, raw: bytes) -> np.ndarray:
        """A hash per word, ASCII letters in lower case; read in chunks that end between words."""
        parts, at = [], 0
        while at < len(raw):
            stop = _BLANK.search(raw, at + _CHUNK) if at + _CHUNK < len(raw) else None
            end = stop.start() if stop else len(raw)
            found = raw[at:end].lower().split()
            if len(self.known) > _CACHE:
                self.known.clear()
            for word in set(found).difference(self.known):
                self.known[word] = xxhash.xxh3_64_intdigest(word)
            parts.append(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def of(self, raw: bytes) -> np.ndarray:
        words = self.hashes(raw)
        if not len(words):
            return words
        size = min(self.words, len(words))
        count = len(words) - size + 1
        out = np.full(count, size, np.uint64)
        for i in range(size):
            out = mix(out + words[i:i + count])
        return np.unique(out)


def buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(20)).astype(np.int64) & ((1 << _BUCKET_BITS) - 1)


def sketch_width(size: int) -> int:
    """Buckets of a sketch: 32 up to 1,024 shingles, four times as many for four times the size."""
    width, reach = 32, 1024
    while size > reach:
        width, reach = width * 4, reach * 4
    return width


def sketch(tokens: np.ndarray) -> np.ndarray:
    width = sketch_width(len(tokens))
    return (np.bincount((tokens >> _U(42)).astype(np.int64) & (width - 1), minlength=width) & 255).astype(np.uint8)


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sketch distance of one row to many; counts go round at 256, and so does their difference."""
    ahead = one - many
    return np.minimum(ahead, many - one).sum(axis=1, dtype=np.int64)


def set_key(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte tells how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _read_sets(words):
    """A row per text, and at the end the counts of the shingles of all texts of the task, by bucket."""
    names = ["doc_id", "place", "n", "key", "sketch", "block", "counts"]

    def rows(batches):
        shingles, counts, kind = Shingles(words), np.zeros(1 << _BUCKET_BITS, np.int64), None
        waiting, waits = [], 0
        for batch in batches:
            kind = batch.column("doc_id").type
            n, keys, sketches = [], [], []
            for text in batch.column("text"):
                tokens = shingles.of(_raw(text))
                waiting.append(buckets(tokens))
                waits += len(tokens)
                if waits > 1 << _BUCKET_BITS:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, waits = [], 0
                n.append(len(tokens))
                keys.append(set_key(tokens))
                sketches.append(sketch(tokens).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        blocks = counts.reshape(-1, _BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            size = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, kind), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()),
                 pa.nulls(size, pa.binary()), pa.array(some, pa.int32()),
                 pa.array([_packed(blocks[b]) for b in some], pa.binary())], names)

    return rows


def _added(batches):
    sums = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            sums[block] = sums.get(block, 0) + _unpacked(_raw(counts))
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_packed(c) for c in sums.values()], pa.binary())], ["block", "counts"])


def _bucket_counts(read: DataFrame) -> np.ndarray:
    """Occurrences per hash bucket over all texts: 2**20 numbers at any size of the corpus."""
    rows = read.where("block is not null").select("block", "counts").repartition("block").mapInArrow(
        _added, "block int, counts binary").toArrow()
    counts = np.zeros((1 << _BUCKET_BITS) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    for block, value in zip(rows.column("block").to_pylist(), rows.column("counts")):
        counts[block] = _unpacked(_raw(value))
    return np.minimum(counts.ravel(), (1 << 32) - 1).astype(np.uint32)


def partner_sizes(s: int, share: int = SHARE) -> range:
    return range(least_overlap(s, share), s * 100 // share + 1)


def _shapes(s: int, share: int):
    """``(low, high, subset size)`` for the pairs of sizes that a set of ``s`` can link in; equal sets are one set."""
    for t in partner_sizes(s, share):
        low, high = min(s, t), max(s, t)
        size = needed(low, high, share)
        if size <= low and not size == low == high:
            yield low, high, size


def prefix_length(s: int, share: int = SHARE) -> int:
    return s - least_overlap(s, share) + 1


def boundary(sizes: dict[int, int], share: int = SHARE, most: int = MOST_SMALL) -> int:
    """The size up to which sets list their subsets, so that the rows to be shuffled are fewest.

    ``sizes`` counts the distinct sets of every size that can link with one of up to ``most``.
    """
    subsets_of = {s: 2 * n * sum(comb(s, size) for _, _, size in _shapes(s, share)) for s, n in sizes.items() if s <= most}
    entries_of = {s: ENTRY_COST * n * prefix_length(s, share) for s, n in sizes.items()}

    def cost(x):
        return (sum(c for s, c in subsets_of.items() if s <= x)
                + sum(c for s, c in entries_of.items() if s >= least_overlap(x + 1, share)))

    return min(range(most + 1), key=lambda x: (cost(x), x))


def subsets(tokens: np.ndarray, limit: int, share: int = SHARE):
    """``(first name, second name, hub)`` of all fixed-size subsets of a set: two hashes name a subset.

    A name is a sum over the members, so it follows from what is left out. ``hub`` tells whether the set is the
    smaller of the pair of sizes: all sets that list a subset link with each hub that lists it.
    """
    s = len(tokens)
    first, second = mix(tokens), mix(tokens ^ _U(0x5851F42D4C957F2D))
    for low, high, size in _shapes(s, share):
        if high > limit:
            continue
        left = np.array(list(combinations(range(s), s - size)), np.int64).reshape(comb(s, size), s - size)
        sizes = _U(low * (MOST_SMALL + 1) + high)
        one = mix(first.sum() - first[left].sum(axis=1, dtype=np.uint64) + sizes)
        two = mix(second.sum() - second[left].sum(axis=1, dtype=np.uint64) + sizes) >> _U(1)
        yield one, two.astype(np.int64), s == low


ENTRIES = "token long, second long, hub boolean, tag long, key binary"


def _entries(words, share, limit, counts):
    """Entries of inverted lists (``second`` is -1) of the sets that a large set can link with, and the subsets of
    small sets."""
    indexed = least_overlap(limit + 1, share)

    def emitted(out):
        tokens, second, hub, key = zip(*out)
        sizes = [len(t) for t in tokens]
        keys = pa.array(key, pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
        tags = np.repeat([int.from_bytes(k[:8], "little", signed=True) for k in key], sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(second)),
             pa.array(np.repeat(hub, sizes)), pa.array(tags), keys], ["token", "second", "hub", "tag", "key"])

    def rows(batches):
        shingles, weight = Shingles(words), counts.value
        for batch in batches:
            done, out, size = set(), [], 0
            for text in batch.column("text"):
                tokens = shingles.of(_raw(text))
                n, key = len(tokens), set_key(tokens)
                if not n or key in done:
                    continue
                done.add(key)
                if n >= indexed:
                    order = np.lexsort((tokens, weight[buckets(tokens)]))[:prefix_length(n, share)]
                    out.append((tokens[order], np.full(len(order), -1), False, key))
                    size += len(order)
                if n <= limit:
                    for one, two, hub in subsets(tokens, limit, share):
                        out.append((one, two, hub, key))
                        size += len(one)
                if size > 1 << 17:
                    yield emitted(out)
                    out, size = [], 0
            if out:
                yield emitted(out)

    return rows


def reached(count: int, near):
    """Links ``(i, j)`` that span the components of ``count`` members.

    ``near(i, rest)`` says which of the members ``rest`` link with ``i``; it is asked about those only that
    nothing has reached yet.
    """
    rest, queue = np.arange(count), []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        i = queue.pop()
        if len(rest):
            hit = near(i, rest)
            for j in rest[hit].tolist():
                yield i, j
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]


def _near_by_sketch(sizes, sketches, share, limit):
    """A test for ``reached`` that may say yes to sets that do not link, but never no to sets that do."""
    rows = [np.frombuffer(x, np.uint8) for x in sketches]
    widths = np.array([len(r) for r in rows])
    tables = {w: np.stack([r.reshape(-1, w).sum(axis=0, dtype=np.uint64).astype(np.uint8) if len(r) >= w
                           else np.zeros(w, np.uint8) for r in rows]) for w in np.unique(widths).tolist()}

    def near(i, rest):
        s, t = sizes[i], sizes[rest]
        least = -(-share * (s + t) // (100 + share))
        hit = (least <= np.minimum(s, t)) & (np.maximum(s, t) > limit)
        for width, table in tables.items():
            some = np.flatnonzero(hit & (np.minimum(widths[i], widths[rest]) == width))
            if len(some):
                hit[some] = apart(table[i], table[rest[some]]) <= s + t[some] - 2 * least[some]
        return hit

    return near


def _grouped(batches, names):
    """Rows of sorted batches, group by group: lists of the columns after the first ``names``."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:names] != key:
                if held:
                    yield held
                key, held = row[:names], []
            if not held or held[-1][0] != row[names]:  # equal sets stand beside each other
                held.append(row[names:])
    if held:
        yield held


def _links(found, size=1 << 14):
    out = []
    for link in found:
        out.append(link)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])


def _candidates(share, limit):
    """Candidate links of each inverted list ``(token, key, n, sketch)``."""

    def links(batches):
        known = set()
        for members in _grouped(batches, 1):
            keys, sizes, sketches = zip(*members)
            if len(keys) < 2 or keys in known:
                continue
            if len(known) > _CACHE:
                known.clear()
            if len(keys) < 8:
                known.add(keys)
            for i, j in reached(len(keys), _near_by_sketch(np.array(sizes), sketches, share, limit)):
                yield keys[i], keys[j]

    return lambda batches: _links(links(batches))


def _verified(words, share):
    """Links of each unit ``(root, tile, other, key, text)``, found by comparing shingles."""

    def links(batches):
        shingles = Shingles(words)
        for members in _grouped(batches, 3):
            sets = [(key, shingles.of(text)) for key, text in members]
            # A text that met the key of another set by its row hash is none of the members.
            sets = [(key, tokens) for key, tokens in sets if set_key(tokens) == key]
            if len(sets) < 2:
                continue
            keys, tokens = zip(*sets)
            sizes = np.array([len(t) for t in tokens])
            maybe = _near_by_sketch(sizes, [sketch(t).tobytes() for t in tokens], share, 0)

            def near(i, rest, tokens=tokens, sizes=sizes, maybe=maybe):
                hit = maybe(i, rest)
                own = tokens[i]
                for at in np.flatnonzero(hit).tolist():
                    other = tokens[rest[at]]
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[place] == other).sum())
                    hit[at] = 100 * both >= share * (len(own) + len(other) - both)
                return hit

            for i, j in reached(len(keys), near):
                yield keys[i], keys[j]

    return lambda batches: _links(links(batches))


LINKS = "a binary, b binary"


def _candidate_links(shelf: Shelf, entries: DataFrame, sets: DataFrame, share: int, limit: int) -> DataFrame:
    lists = entries.where("second = -1")
    # The large joins are merge joins at every size, so that shuffles stay in proportion to the input.
    # A set that stands in several batches repeats its entries; a list is alive if it holds two sets.
    alive = (lists.groupBy("token").agg(F.count("*").alias("members"), F.min("tag").alias("low"), F.max("tag").alias("high"))
             .where("low <> high").select("token", "members"))
    alive = shelf.put("lists", lists.join(alive.hint("merge"), "token").select("token", "members", "key"))
    long = alive.where(F.col("members") > LIST_MEMBERS)
    hubs = long.groupBy("token").agg(F.min("key").alias("hub"))
    together = long.join(hubs, "token").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    short = (alive.where(F.col("members") <= LIST_MEMBERS).join(sets.select("key", "n", "sketch").hint("merge"), "key")
             .select("token", "key", "n", "sketch").repartition("token").sortWithinPartitions("token", "key"))
    return together.unionByName(short.mapInArrow(_candidates(share, limit), LINKS)).where("a <> b").distinct()


def _compared(units: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """Compare the sets of each unit ``(root, tile, other, key)``."""
    rows = units.join(texts, "key").select("root", "tile", "other", "key", "text")
    rows = rows.repartition("root", "tile", "other").sortWithinPartitions("root", "tile", "other", "key")
    return rows.mapInArrow(_verified(words, share), LINKS)


def _large_links(shelf: Shelf, docs: DataFrame, sets: DataFrame, candidates: DataFrame, words: int,
                 share: int) -> list[DataFrame]:
    """Links among candidates that shingles confirm."""
    groups = shelf.put("groups", connected_components(candidates).toDF("key", "root")
                       .join(sets.select("key", "n", "place").hint("merge"), "key"))
    texts = shelf.put("texts", docs.join(groups.select("place", "key").hint("merge"), "place").select("key", F.col("text").cast("binary")))
    tiles = groups.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("tiles"))
    members = shelf.put("members", groups.join(tiles, "root").select(
        "root", "key", "n", "tiles", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile")))
    # The first set of a group goes to all its tiles.
    places = F.when(F.col("key") == F.col("root"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    units = members.select("root", F.explode(places).alias("tile"), F.lit(0).alias("other"), "key")
    links = shelf.put("links", _compared(units, texts, words, share))
    tiled = members.where("tiles > 1")
    if tiled.isEmpty():
        return [links]
    # What the first set does not reach meets all tiles of its group.
    inside = connected_components(links.join(tiled.select(F.col("key").alias("a")), "a", "left_semi")).toDF("key", "reached")
    rest = shelf.put("rest", tiled.join(inside, "key", "left").where("not reached <=> root").drop("reached"))
    shares = rest.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("others"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rest.join(shares, "root").select(
        "root", every("tiles").alias("tile"), F.pmod(F.xxhash64("key"), F.col("others")).cast("int").alias("other"), "key")
    asked = tiled.join(shares, "root").select("root", "tile", every("others").alias("other"), "key")
    return [links, shelf.put("more-links", _compared(asking.union(asked).distinct(), texts, words, share))]


def similar_sets(docs: DataFrame, words: int = WORDS, share: int = SHARE, limit: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``(doc_id, text)``.

    Texts link when their sets of distinct shingles share ``share`` hundredths of their union or more; a component
    is all that links reach, its id the smallest ``doc_id`` in it. A text with fewer words than a shingle is one
    shingle; without a word (null, empty, blank) it has none and is alone. Shingles are told apart by 64-bit
    hashes, sets and subsets by 128 bits. Rows that repeat an id are rows of their own; null ids are passed over
    when the smallest is sought (null if there is no other). ``limit`` replaces the boundary between small and
    large sets, which the sizes decide otherwise. An empty table gives no rows; other columns are not read.
    """
    shelf = Shelf(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")
    schema = f"doc_id {kind}, place long, n long, key binary, sketch binary, block int, counts binary"
    read = shelf.put("read", placed.mapInArrow(_read_sets(words), schema))
    rows = read.where("block is null")
    sets = shelf.put("sets", rows.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("place").alias("place"),
        F.min("doc_id").alias("doc_id")))
    if limit is None:
        sizes = sets.where(F.col("n") <= (MOST_SMALL + 1) * 100 // share + 1).groupBy("n").count().collect()
        limit = boundary({r["n"]: r["count"] for r in sizes}, share)
    counts = docs.sparkSession.sparkContext.broadcast(_bucket_counts(read))
    entries = shelf.put("entries", placed.select("text").mapInArrow(_entries(words, share, limit, counts), ENTRIES))

    listed = entries.where("second >= 0")
    hubs = listed.where("hub").groupBy("token", "second").agg(F.min("key").alias("hub_key"))
    links = [listed.join(hubs, ["token", "second"]).where("key <> hub_key")
             .select(F.col("hub_key").alias("a"), F.col("key").alias("b")).distinct()]
    candidates = shelf.put("candidates", _candidate_links(shelf, entries, sets, share, limit))
    shelf.drop("lists")
    links += _large_links(shelf, placed.select("place", "text"), sets, candidates, words, share)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    roots = connected_components(found).toDF("key", "root")
    grouped = sets.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = shelf.put("classes", grouped.join(least, "root").select("key", "component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(classes.hint("merge"), "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
