"""Suffix-array dedup: bytes covered by a long string that occurs more than once in the corpus.

Suffixes are ordered only through ``threshold`` bytes, by most-significant-digit passes over
groups: a group of equal prefixes is split by its next digit, a group of one leaves at once, and
groups that are still equal at full depth are exactly the repeated windows. Digits are compared
by 64-bit fingerprints within a group, so the order inside a pass is that of the fingerprints, and
windows are equal when two or three fingerprints are: bytes are not compared again. Chance makes that
safe, an adversary who knows the symbols of ``arrays.py`` could build strings that agree.

Sorting every byte position would shuffle many times the corpus. The first digit is therefore read
at synchronising positions only: of all digits that begin inside a window of ``threshold`` bytes,
the one with the smallest fingerprint (the leftmost if equal) speaks for the window. Equal windows
hold equal digits, so their speakers stand at the same place, and no repeated window is missed.
A speaker covers a run of window starts; three digits decide about them:

1. the ``head`` bytes at the speaker. Unique: none of its windows repeats. If the whole run of
   windows with its bytes is found again, all of them repeat;
2. for what is left, per block of window starts, the bytes that all windows of the block share;
3. for the blocks that are left, each whole window.

Every pass is a group-by with partial aggregation of (smallest, largest position id) and an
equi-join, which adaptive execution splits for hot groups. Positions never meet in pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.llm.arrays import SLICE_BYTES, PrefixHash, flat, mix, shared_minimum, slices
from priceloom.llm.workspace import Shelf, stored

_U = np.uint64
_INDEX_BITS = _U(22)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _pieces(data, offsets, threshold):
    """Texts cut into overlapping stretches that together begin every window exactly once."""
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        step = SLICE_BYTES
        for at in range(begin, max(begin + 1, end - threshold + 1), step):
            yield row, begin, at, min(end, at + step + threshold - 1)


def _speakers(data, start, stop, threshold, head):
    """For stretches ``start:stop`` of ``data``: speaker, first and last window start, digit, run."""
    hashes = PrefixHash(data)
    grams = hashes.grams(head)
    order = (mix(grams) >> _INDEX_BITS << _INDEX_BITS) | np.arange(len(grams), dtype=np.uint64)
    lowest = shared_minimum(order, threshold - head + 1)
    speaker = (lowest & ((_U(1) << _INDEX_BITS) - _U(1))).astype(np.int64)
    inside = np.zeros(len(data) + 2, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, stop - threshold + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:len(speaker)] > 0)
    own = speaker[starts]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at, low = own[first], starts[first]
    high = starts[np.r_[first[1:], len(starts)] - 1]
    shape = mix((at - low).astype(np.uint64) * _U(1_000_003) + (high - low).astype(np.uint64))
    run = mix(hashes.of(low, high + threshold) + shape)
    return at, low, high, grams[at], run


def _heads(threshold, head):
    names = ["key", "digit", "run", "id", "id_again", "at", "low", "high", "stop"]

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                keys = part.column("key")
                found = []
                if len(data) <= SLICE_BYTES:
                    long = np.flatnonzero(np.diff(offsets) >= threshold)
                    stretches = [(data, 0, long, offsets[:-1][long], offsets[1:][long])] if len(long) else []
                else:
                    stretches = ((data[a:b], a - begin, np.array([row]), np.array([0]), np.array([b - a]))
                                 for row, begin, a, b in _pieces(data, offsets, threshold) if b - a >= threshold)
                for piece, shift, which, start, stop in stretches:
                    at, low, high, digit, run = _speakers(piece, start, stop, threshold, head)
                    place = np.searchsorted(start, low, side="right") - 1
                    row, origin = which[place], start[place] - shift
                    # In periodic text neighbours are alike: one row stands for them and repeats by itself.
                    new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (digit[1:] != digit[:-1])
                                               | (row[1:] != row[:-1])])
                    last = np.r_[new[1:], len(at)] - 1
                    found.append((row[new], digit[new], run[new], at[new] - origin[new], low[new] - origin[new],
                                  high[new] - origin[new], high[last] - origin[new] + threshold, last > new))
                if not found:
                    continue
                row, digit, run, at, low, high, stop, again = (np.concatenate(x) for x in zip(*found))
                seed = np.frombuffer(b"".join(k.as_py()[:8] for k in keys), np.uint64)[row]
                ident = mix(seed + (at.astype(np.uint64) << _U(1)) * _U(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), *(pa.array(x.view(np.int64)) for x in (
                        digit, run, ident, np.where(again, ident ^ _U(1), ident), at, low, high, stop))], names)

    return rows


HEADS = "key binary, digit long, run long, id long, id_again long, at long, low long, high long, stop long"


def _contexts(threshold):
    """The bytes around each speaker that later digits are read from."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                asked = part.column("asked")
                owner = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
                if not len(owner):
                    continue
                entries = asked.flatten()
                fields = {name: entries.field(i) for i, name in enumerate(_ASKED)}
                begin = offsets[:-1][owner]
                low = fields["low"].to_numpy() + begin
                stop = fields["high"].to_numpy() + begin + threshold
                raw = data.tobytes()
                context = pa.array([raw[a:b] for a, b in zip(low.tolist(), stop.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(owner)), *(fields[n] for n in _ASKED), context],
                    ["key", *_ASKED, "context"])

    return rows


_ASKED = ["digit", "id", "needed", "at", "low", "high"]
CONTEXTS = ("key binary, digit long, id long, needed boolean, at long, low long, high long, context binary")
NODES = ("key binary, digit long, id long, needed boolean, at long, first long, last long, shared long, whole long")


def _nodes(threshold, width, ranged):
    """Blocks of ``width`` window starts: fingerprints of the bytes they share and of all their bytes."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "context"):
                data, offsets = flat(part.column("context"))
                take = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("digit", "id", "at", "low", "high")}
                owner = np.arange(part.num_rows)
                near, far = take["at"] - take["high"], take["at"] - take["low"]  # speaker minus window start
                if ranged:
                    left = part.column("left")
                    owner = np.repeat(owner, left.value_lengths().to_numpy(zero_copy_only=False))
                    pairs = left.flatten()
                    # The speaker at the border of two pieces of a text has a context in each and is asked for the
                    # windows of both: each context reads its own.
                    low, high = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                    own = (low >= near[owner]) & (high <= far[owner])
                    owner, near, far = owner[own], low[own], high[own]
                if not len(owner):
                    continue
                count = far // width - near // width + 1
                node = np.repeat(np.arange(len(owner)), count)
                block = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + (near // width)[node]
                first = np.maximum(block * width, near[node])
                last = np.minimum(block * width + width - 1, far[node])
                owner = owner[node]
                hashes = PrefixHash(data)
                base = offsets[:-1][owner] + (take["at"] - take["low"])[owner]  # the speaker in data
                shared = hashes.of(base - block * width, base - (block * width + width - 1) + threshold)
                whole = hashes.of(base - last, base - first + threshold)
                shared = mix(shared + mix(block.astype(np.uint64)))
                whole = mix(whole + mix((first * 4096 + last).astype(np.uint64)))
                index = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(index), pa.array(take["digit"][owner]), pa.array(take["id"][owner]),
                     part.column("needed").take(index), pa.array(take["at"][owner]), pa.array(first), pa.array(last),
                     pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["key", "digit", "id", "needed", "at", "first", "last", "shared", "whole"])

    return rows


def _repeated(df: DataFrame, *group: str) -> DataFrame:
    """Groups that hold more than one position."""
    return (df.groupBy(*group).agg(F.min("id").alias("id_low"), F.max("id").alias("id_high"))
            .where("id_low <> id_high"))


def repeated_spans(docs: DataFrame, text: str = "text", threshold: int = 400, shelf: Shelf | None = None) -> DataFrame:
    """Where long strings repeat: one row ``(key, spans)`` per text that holds any.

    ``key`` is ``text_key`` of the text, ``spans`` an array of ``(start, stop)`` byte ranges, unsorted and
    overlapping, whose union is every byte covered by a ``threshold``-byte string that also starts
    elsewhere in another text or at another place of this one. Texts that occur in several rows count
    once here; see ``remove_repeats``. Nulls and texts shorter than ``threshold`` have no spans.

    The passes run when this is called. Their tables lie in the shared folder, on ``shelf``; one goes as soon
    as its successor is written, and only the spans are left at the end.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    head = max(1, threshold * 8 // 25)
    block = max(1, threshold // 25)  # window starts that the second digit decides about together
    source = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= threshold)
    keyed = source.select(text_key(F.col("text")).alias("key"), "text")
    heads = keyed.mapInArrow(_heads(threshold, head), HEADS)
    digits = (heads.groupBy("digit").agg(F.min(F.least("id", "id_again")).alias("id_low"),
                                         F.max(F.greatest("id", "id_again")).alias("id_high"))
              .where("id_low <> id_high").select("digit"))
    alive = shelf.put("heads", heads.join(digits, "digit"))
    runs = alive.groupBy("digit", "run").agg(
        F.min("id").alias("first_id"),
        (F.min(F.least("id", "id_again")) != F.max(F.greatest("id", "id_again"))).alias("repeats"))
    kinds = runs.groupBy("digit").agg((F.count("*") > 1).alias("mixed"))
    groups = shelf.put("groups", runs.join(kinds.select("digit", "mixed"), "digit"))
    alive = shelf.put("alive", alive.join(groups, ["digit", "run"]).select(
        "key", "digit", "id", "at", "low", "high", "stop", "repeats",
        (~F.col("repeats") | ((F.col("id") == F.col("first_id")) & F.col("mixed"))).alias("asked")))
    shelf.drop("heads", "groups")
    spans = alive.where("repeats").select("key", F.col("low").alias("start"), "stop")

    asked = (alive.where("asked").groupBy("key").agg(F.collect_set(F.struct(
        "digit", "id", (~F.col("repeats")).alias("needed"), "at", "low", "high")).alias("asked")))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    contexts = shelf.put("contexts", texts.join(asked, "key").mapInArrow(_contexts(threshold), CONTEXTS))
    nodes = contexts.mapInArrow(_nodes(threshold, block, False), NODES)
    shared = _repeated(nodes, "digit", "shared").select("digit", "shared")
    nodes = shelf.put("blocks", nodes.join(shared, ["digit", "shared"]))
    whole = _repeated(nodes, "digit", "whole").select("digit", "whole", F.lit(True).alias("all_repeat"))
    nodes = shelf.put("nodes", nodes.join(whole, ["digit", "whole"], "left"))
    shelf.drop("blocks")
    spans = spans.unionByName(_as_spans(nodes.where("all_repeat and needed"), threshold))

    # A block that repeats as a whole still shows its windows to the blocks that do not.
    left = nodes.groupBy("key", "at").agg(F.collect_set(F.struct("first", "last")).alias("left"))
    mixed = nodes.groupBy("digit").agg(F.max(F.col("all_repeat").isNull()).alias("mixed")).where("mixed")
    windows = (contexts.join(left, ["key", "at"]).join(mixed.select("digit"), "digit")
               .select(*contexts.columns, "left")
               .mapInArrow(_nodes(threshold, 1, True), NODES))
    equal = _repeated(windows, "digit", "whole").select("digit", "whole")
    spans = spans.unionByName(_as_spans(windows.where("needed").join(equal, ["digit", "whole"]), threshold))
    spans = shelf.put("spans", spans.groupBy("key", "start").agg(F.max("stop").alias("stop"))
                      .groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    shelf.drop("alive", "contexts", "nodes")
    return spans


def _as_spans(nodes: DataFrame, threshold: int) -> DataFrame:
    return nodes.select("key", (F.col("at") - F.col("last")).alias("start"),
                        (F.col("at") - F.col("first") + threshold).alias("stop"))


def _cut(threshold):
    """Remove the spans from each text."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, copies, spans in zip(part.column("key"), part.column("text"), part.column("copies"),
                                                    part.column("spans")):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    if copies.as_py() > 1 and len(raw) >= threshold:
                        kept, count = b"", 1
                    elif spans.is_valid:
                        pairs = spans.values
                        start, stop = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                        order = np.argsort(start, kind="stable")
                        start, reach = start[order], np.maximum.accumulate(stop[order])
                        new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                        begin, end = start[new], reach[np.r_[new[1:], len(start)] - 1]
                        edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(raw)]
                        kept, count = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), len(new)
                    else:
                        kept, count = raw, 0
                    out.append((key.as_py(), len(raw), len(raw) - len(kept), count, kept))
                keys, size, removed, count, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                    ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows


CUT = "key binary, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, text: str = "text", threshold: int = 400) -> DataFrame:
    """Every distinct text without the bytes that repeat: ``(key, n_bytes, n_removed, n_spans, kept)``.

    Bytes count as repeated if a ``threshold``-byte string covers them that also starts elsewhere, in another
    row or the same text; judged on the input, so all occurrences go. A text of at least ``threshold``
    bytes that stands in several rows is removed whole. A null text counts as empty. ``kept`` holds
    the remaining bytes (UTF-8 may be cut inside a character). Ties need no rule: positions of a
    group are treated alike. An empty table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, text, threshold)
    texts = (docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
             .select(text_key(F.col("text")).alias("key"), "text")
             .groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    return texts.join(spans, "key", "left").mapInArrow(_cut(threshold), CUT)


def repeat_report(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """Per row of ``(doc_id, text)``: sizes and the digest of the bytes that are kept."""
    parts = remove_repeats(docs, "text", threshold).select(
        "key", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    rows = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    return rows.join(stored(parts), "key").drop("key")

