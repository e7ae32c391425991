"""A random forest without a depth limit, whose trees are grown and kept by the executors.

The built-in learner collects a few thousand nodes per round and keeps every tree in the driver; trees that end in
single rows have as many nodes as rows. Here features are cut into bins and each row counts in each tree as often as a hash of
its number says. Rows are dealt by their set of bins once, and what a tree draws of a set is added up before anything else:
an entry of one weight and one sum, however many rows share the set. Rounds over all blocks split the upper nodes of all
trees by sums per bin; only the chosen splits reach the driver. A node of at most ``GROUP_ROWS`` entries goes with them to
one task, which grows what lies below it: a subtree, one row of a Parquet table. Scoring deals the distinct sets of bins of
the rows to the subtrees, in blocks, and adds up their values.
"""

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.session import checkpointed, ensure_checkpoint_dir

BINS = 128
#: A node with more entries, drawn rows of one set of bins being one, is split by all tasks together.
GROUP_ROWS = 1 << 21
#: Nodes per round over the blocks; a task keeps the sums per bin of all of them.
ROUND_NODES = 8192
#: Rows that a task handles at once, and bytes that it passes on at once.
STRETCH_ROWS, SENT_BYTES = 1 << 18, 16 << 20
#: Entries whose nodes a task splits at once, few enough for a cache; with so many for each node sums by bin cost less than sorting.
PIECE_ROWS, DENSE = 1 << 16, 48
#: Sets of bins that are scored as a block; a place among them takes two bytes.
ASKED_CELLS = 1 << 16
#: Gains this close, as a share, are equal: the first feature, then the lowest bin, is taken wherever a node is split.
TIE = 1e-9
#: Subtrees in a Parquet file, so that a reader holds few at a time.
FILE_SUBTREES = 4

_U = np.uint64
BLOCKS = "first long, cells binary, sizes binary, targets binary"
SUMS = "tree int, node int, part long, sums binary"
BEST = ("tree int, node int, feature int, split int, gain double, weight_left double, weight_right double, sum_left double, sum_right double, "
        "rows_left double, rows_right double")
DEALT = "group int, part long, cells binary, weights binary, lows binary, mixed binary, highs binary, totals binary"
SUBTREES = "group int, tree int, feature binary, split binary, value binary, gains array<double>"
ASKED = "group int, block long, places binary, cells binary"
ANSWERED = "block long, places binary, cells binary, value binary"
_SUBTREE_SCHEMA = pa.schema([("group", pa.int32()), ("tree", pa.int32()), *((n, pa.binary()) for n in ("feature", "split", "value")),
                             ("gains", pa.list_(pa.float64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _draws() -> np.ndarray:
    """How often a row counts in a tree, by 16 bits of its hash: Poisson with mean 1."""
    chance = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))
    return np.searchsorted(chance, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_DRAWS = _draws()


def _copies(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    salt = int(_mix(np.array([seed * 1_000_003 + tree + 1], _U))[0])
    return _DRAWS[_mix(rows.view(_U) + _U(salt)) >> _U(48)]


def _to_binary(cells: np.ndarray) -> pa.Array:
    n, d = cells.shape
    offsets = np.arange(n + 1, dtype=np.int32) * d
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells))])


def _from_binary(column: pa.Array, d: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, d), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, d)


def _bins_of(thresholds: list[list[float]]):
    """The bins of an array of features, one byte each: bin b holds values above b thresholds."""
    cuts = [np.array(t) for t in thresholds]

    @F.arrow_udf("binary")
    def cell(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
        out = np.empty(values.shape, np.uint8)
        for i, cut in enumerate(cuts):
            out[:, i] = np.searchsorted(cut, values[:, i])
        return _to_binary(out)

    return cell


def _thresholds(rows: DataFrame, n_features: int) -> tuple[list[list[float]], int, float]:
    """Thresholds of each feature, the number of rows and the largest absolute target.

    All distinct values of a feature that has few, else quantiles of all rows.
    """
    x = [F.get("_x", F.lit(i)) for i in range(n_features)]
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    wrong = F.col("_y").isNull() | F.isnan("_y") | (F.abs("_y") == float("inf"))
    found = rows.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.max(F.abs("_y")).alias("top"),
                     *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(x)],
                     *[F.max(c).alias(f"m{i}") for i, c in enumerate(x)],
                     *[F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
    if not found["n"]:
        raise ValueError("no rows to train on")
    if found["wrong"]:
        raise ValueError(f"{found['wrong']} targets are null, not a number or infinite")
    thresholds = []
    for i, c in enumerate(x):
        cuts = sorted({v for v in found[f"q{i}"] if v < found[f"m{i}"]})
        if found[f"d{i}"] <= 2 * BINS:
            values = sorted(r[0] for r in rows.select(c).distinct().limit(BINS + 1).collect())
            if len(values) <= BINS:
                cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        thresholds.append(cuts)
    return thresholds, found["n"], found["top"]


def _leaf(top: tuple, cells: np.ndarray) -> np.ndarray:
    """The node of the upper part of a tree, ``(feature, split, below)``, that each row comes to."""
    feature, split, below = top
    at, every = np.zeros(len(cells), np.int32), np.arange(len(cells))
    while True:
        asked = feature[at]
        inner = asked >= 0
        if not inner.any():
            return at
        right = cells[every, np.maximum(asked, 0)] > split[at]
        at = np.where(inner, below[at] + right, at)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= STRETCH_ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


class _Block:
    """Rows in the order of their bins and targets: sets of bins, and of each row its number, its set's place and its target."""

    def __init__(self, batch: pa.RecordBatch, i: int, d: int):
        cells, sizes, y = (np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                           for c, kind in (("cells", np.uint8), ("sizes", np.int32), ("targets", float)))
        self.first, self.cells, self.y = batch.column("first")[i].as_py(), cells.reshape(-1, d), y
        self.rows = np.arange(self.first, self.first + len(y), dtype=np.int64)
        self.set = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def drawn(self, tree: int, seed: int) -> tuple[np.ndarray, ...]:
        """Of each set that a tree draws from, its place, how many rows count, the sum, the least and the largest of their targets."""
        copies = _copies(self.rows, tree, seed)
        here = np.flatnonzero(copies)
        place, y, copies = self.set[here], self.y[here], copies[here].astype(float)
        if not len(here):
            return place, copies, y, y, y
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return (place[start], np.add.reduceat(copies, start), np.add.reduceat(copies * y, start),
                y[start], y[np.r_[start[1:], len(y)] - 1])


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i, d)


def _packed(d: int):
    """Blocks of rows ``(cell, y)`` that come in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in _stretches(batches):
            cells, y = _from_binary(batch.column("cell"), d), batch.column("y").to_numpy()
            start = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[start, len(y)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (cells[start], sizes, y))],
                                             ["first", "cells", "sizes", "targets"])
            first += len(y)

    return rows


def _sums(tops: dict[int, tuple], active: dict[int, list[int]], d: int, centre: float, seed: int):
    """Of each active node, weight, weighted target and entries by feature and bin."""

    def rows(batches):
        part, found = None, {}
        for block in _blocks(batches, d):
            part = block.first if part is None else part
            for tree, nodes in active.items():
                slot = np.full(len(tops[tree][0]), -1, np.int64)
                slot[nodes] = np.arange(len(nodes))
                place, weight, total, _, _ = block.drawn(tree, seed)
                cells = block.cells[place]
                node = slot[_leaf(tops[tree], cells)]
                if (node < 0).any():
                    here = np.flatnonzero(node >= 0)
                    node, cells, weight, total = node[here], cells[here], weight[here], total[here]
                total = total - centre * weight
                sums = found.setdefault(tree, np.zeros((3, len(nodes), d, BINS)))
                for f in range(d):
                    index = node * BINS + cells[:, f]
                    for k, values in enumerate((weight, total, None)):
                        sums[k, :, f] += np.bincount(index, values, len(nodes) * BINS).reshape(-1, BINS)
        for tree, total in found.items():
            nodes = active[tree]
            sent = [total[:, i].tobytes() for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(tree, pa.int32()), len(nodes)), pa.array(nodes, pa.int32()),
                                              pa.repeat(pa.scalar(part, pa.int64()), len(nodes)), pa.array(sent, pa.binary())],
                                             ["tree", "node", "part", "sums"])

    return rows


def _best(d: int, least: int):
    """The best split of a node; no row if none gains."""

    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        sums = sum(np.frombuffer(b.as_py()).reshape(-1, d, BINS) for b in table.column("sums"))
        # Where entries are not counted by themselves, each row is one.
        weight, total, entries = sums[0], sums[1], sums[-1] if len(sums) > 2 else sums[0]
        whole, value = weight[0].sum(), total[0].sum()
        left, below = np.cumsum(weight, axis=1), np.cumsum(total, axis=1)
        right, above = whole - left, value - below
        fits = (weight > 0) & (left >= least) & (right >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = below**2 / left + above**2 / right
            gain = np.where(fits, sides - value**2 / whole, 0.0)
        feature, at = np.unravel_index(np.argmax(gain >= gain.max() * (1 - TIE)), gain.shape)
        found = []
        if gain[feature, at] > 1e-12 * sides[feature, at]:
            rows_left = entries[feature, :at + 1].sum()
            found = [{"tree": key[0].as_py(), "node": key[1].as_py(), "feature": int(feature), "split": int(at),
                      "gain": gain[feature, at], "weight_left": left[feature, at], "weight_right": right[feature, at],
                      "sum_left": below[feature, at], "sum_right": above[feature, at],
                      "rows_left": rows_left, "rows_right": entries[feature].sum() - rows_left}]
        kinds = {"tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "split": pa.int32()}
        names = [c.split()[0] for c in BEST.split(", ")]
        return pa.Table.from_pylist(found, pa.schema([(n, kinds.get(n, pa.float64())) for n in names]))

    return split


def _sent(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _by_group(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that occurs and the places of its members, in order."""
    order = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.diff(groups[order])) + 1
    for members in np.split(order, edges) if len(order) else ():
        yield int(groups[members[0]]), members


def _deal(tops: list[tuple], d: int, seed: int):
    """Entries by the group that grows them, packed; only those whose targets differ carry their sum and their largest target."""
    names, kinds = [c.split()[0] for c in DEALT.split(", ")], [pa.int32(), pa.int64(), *[pa.binary()] * 6]

    def rows(batches):
        out, size = [], 0
        for block in _blocks(batches, d):
            for tree, top in enumerate(tops):
                place, weight, total, low, high = block.drawn(tree, seed)
                kept = block.cells[place]
                for group, members in _by_group(top[3][_leaf(top[:3], kept)]):
                    if group >= 0:
                        mixed = np.flatnonzero(low[members] != high[members])
                        which = members[mixed]
                        packed = (kept[members], weight[members].astype(np.uint32), low[members], mixed.astype(np.int32), high[which], total[which])
                        out.append((group, block.first, *(x.tobytes() for x in packed)))
                        size += len(members) * (d + 12)
                if size > SENT_BYTES:
                    yield _sent(out, names, kinds)
                    out, size = [], 0
        if out:
            yield _sent(out, names, kinds)

    return rows


def _merged(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of the same bins stand together, and where each set of bins begins."""
    n, d = cells.shape
    padded = np.zeros((n, -(-d // 8) * 8), np.uint8)
    padded[:, :d] = cells
    words = padded.view(_U)
    order = np.lexsort(words.T)
    return order, np.flatnonzero(np.r_[True, (np.diff(words[order].view(np.int64), axis=0) != 0).any(axis=1)])


def _by_bin(bins, w, t, node, starts, whole):
    """Candidate splits of one feature from sums by bin: ``(node, weight and sum on the left, bin)``."""
    index = node * BINS + bins
    weights = np.bincount(index, w, len(starts) * BINS).reshape(-1, BINS)
    left, below = np.cumsum(weights, axis=1), np.cumsum(np.bincount(index, t, weights.size).reshape(-1, BINS), axis=1)
    own, at = np.nonzero((weights > 0) & (left < whole[:, None]))
    return own, left[own, at], below[own, at], at


def _by_order(bins, w, t, node, starts, whole):
    """The same by sorting."""
    key = (node.astype(_U) << _U(40)) | (bins.astype(_U) << _U(32)) | np.arange(len(node), dtype=_U)
    key.sort()
    order, at = (key & _U(0xFFFFFFFF)).astype(np.int64), key >> _U(32)
    w, t = w[order], t[order]
    left, below = np.cumsum(w), np.cumsum(t)
    edge = np.flatnonzero((at[1:] != at[:-1]) & (node[1:] == node[:-1]))
    own = node[edge]
    return own, left[edge] - (left[starts] - w[starts])[own], below[edge] - (below[starts] - t[starts])[own], (at[edge] & _U(255)).astype(np.uint8)


def _choose(bins, weight, total, node, starts, whole, value, floor, least):
    """Per node the best feature, -1 for none, its bin and its gain."""
    n_nodes = len(starts)
    best, feature, split = floor.copy(), np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.uint8)
    parent = value**2 / whole
    candidates = _by_bin if len(node) >= DENSE * n_nodes else _by_order
    for f in range(len(bins)):
        own, left, below, at = candidates(bins[f], weight, total, node, starts, whole)
        right = whole[own] - left
        if least > 1:
            fits = (left >= least) & (right >= least)
            own, left, below, at, right = (a[fits] for a in (own, left, below, at, right))
        if not len(own):
            continue
        gain = below**2 / left + (value[own] - below)**2 / right - parent[own]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        top = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain >= np.repeat(top - np.abs(top) * TIE, np.diff(np.r_[first, len(own)])))
        hit = hit[np.r_[True, own[hit][1:] != own[hit][:-1]]]
        wins = top > best[own[first]] * (1 + TIE)
        nodes, hit = own[first][wins], hit[wins]
        best[nodes], feature[nodes], split[nodes] = top[wins], f, at[hit]
    return feature, split, best


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Neighbouring nodes with few entries together, a larger one alone: ``(node, end, entry, end)``."""
    ends = np.cumsum(sizes)
    node = entry = 0
    while node < len(sizes):
        end = max(node + 1, int(np.searchsorted(ends, entry + PIECE_ROWS, "right")))
        yield node, end, entry, int(ends[end - 1])
        node, entry = end, int(ends[end - 1])


def _halves(bins, feature, split, sizes):
    """The entries of the nodes that are split, left ones before right ones, else in the same order, and the sizes of both sides."""
    n = bins.shape[1]
    node = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    asked = feature[node]
    high = bins[np.maximum(asked, 0), np.arange(n)] > split[node]
    inner = feature >= 0
    places = np.arange(n)
    if not inner.all():
        places = np.flatnonzero(inner[node])
        node, high = (np.cumsum(inner, dtype=np.int32) - 1)[node[places]], high[places]
    sizes = sizes[inner]
    highs = np.bincount(node, high, len(sizes)).astype(np.int64)
    lows = sizes - highs
    seen = np.cumsum(high)
    to = np.where(high, seen - 1 + np.cumsum(lows)[node], np.arange(len(node)) - seen + (np.cumsum(highs) - highs)[node])
    order = np.empty_like(places)
    order[to] = places
    return order, np.column_stack([lows, highs]).ravel()


def _grow(cells, weight, total, low, high, depth: int, least: int):
    """A tree of sets of bins: nodes level by level as ``(feature, split, below)``, values of leaves, gains by feature.

    ``below`` is the left child of an inner node, with the right one after it, and the place of a leaf's value.
    """
    d = cells.shape[1]
    levels, values, gains, bins = [], [], np.zeros(d), np.ascontiguousarray(cells.T)
    sizes = np.array([len(cells)])
    while True:
        starts = np.cumsum(sizes) - sizes
        whole, value = np.add.reduceat(weight, starts), np.add.reduceat(total, starts)
        spread = np.maximum.reduceat(high, starts) - np.minimum.reduceat(low, starts)
        open_ = (spread > 0) & (sizes > 1) & (depth > len(levels))
        feature, split = np.full(len(sizes), -1, np.int16), np.zeros(len(sizes), np.uint8)
        found = np.flatnonzero(open_)
        if len(found) < len(sizes):
            # Leaves need their entries no more.
            kept = np.flatnonzero(np.repeat(open_, sizes))
            bins, weight, total, low, high = bins[:, kept], weight[kept], total[kept], low[kept], high[kept]
            sizes = sizes[found]
        floor = 1e-12 * (whole * spread**2)[found]
        for a, b, i, j in _pieces(sizes):
            nodes, own = found[a:b], np.repeat(np.arange(b - a), sizes[a:b])
            feature[nodes], split[nodes], gain = _choose(bins[:, i:j], weight[i:j], total[i:j], own, np.cumsum(sizes[a:b]) - sizes[a:b],
                                                         whole[nodes], value[nodes], floor[a:b], least)
            inner = feature[nodes] >= 0
            gains += np.bincount(feature[nodes][inner], gain[inner], d)
        leaf = feature < 0
        levels.append((feature, split))
        values.append((value / whole)[leaf])
        if leaf.all():
            break
        order, sizes = _halves(bins, feature[found], split[found], sizes)
        bins, weight, total, low, high = bins[:, order], weight[order], total[order], low[order], high[order]
    feature, split = (np.concatenate(x) for x in zip(*levels))
    return (feature, split, _below(feature)), np.concatenate(values), gains


def _below(feature: np.ndarray) -> np.ndarray:
    """What nodes that stand level by level point to: children in the order of their parents, values in that of the leaves."""
    inner = feature >= 0
    rank = np.cumsum(inner)
    return np.where(inner, 2 * rank - 1, np.arange(len(feature)) - rank).astype(np.int32)


def _grown(trees: list[int], depths: list[int], d: int, least: int, scale: float):
    """The subtree of a group."""

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        cells, weight, low, high, total = _entries(table.sort_by("part"), d)
        order, first = _merged(cells)
        weight, low, high, total = weight[order], low[order], high[order], total[order]
        centre = total.sum() / weight.sum()
        top, values, gains = _grow(cells[order[first]], np.add.reduceat(weight, first), np.add.reduceat(total - weight * centre, first),
                                   np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), depths[group], least)
        return _subtrees([(group, trees[group], *top[:2], np.rint((values + centre) * scale).astype(np.int64), gains.tolist())])

    return grow


def _entries(table: pa.Table, d: int) -> tuple[np.ndarray, ...]:
    """Sets of bins, weights, least and largest targets and sums of a group, unpacked."""
    kinds = {"cells": np.uint8, "weights": np.uint32, "lows": float}
    cells, weight, low = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items())
    weight, high = weight.astype(float), low.copy()
    total, at = weight * low, 0
    for lows, *mixed in zip(*(table.column(c).to_pylist() for c in ("lows", "mixed", "highs", "totals"))):
        where, highs, totals = (np.frombuffer(x, kind) for x, kind in zip(mixed, (np.int32, float, float)))
        high[at + where], total[at + where] = highs, totals
        at += len(lows) // 8
    return cells.reshape(-1, d), weight, low, high, total


def _subtrees(rows: list[tuple]) -> pa.Table:
    packed = [(g, t, (f.astype(np.int8) if f.max() < 128 else f).tobytes(), s.tobytes(), v.tobytes(), gains) for g, t, f, s, v, gains in rows]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*packed), _SUBTREE_SCHEMA.types)], schema=_SUBTREE_SCHEMA)


def _asked(tops: list[tuple], d: int):
    """Blocks of sets of bins by the group that knows their value, packed with their places in the block."""
    names, kinds = [c.split()[0] for c in ASKED.split(", ")], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def rows(batches):
        out, size, block = [], 0, TaskContext.get().partitionId() << 33
        for batch in _stretches(batches):
            every = _from_binary(batch.column("cell"), d)
            for i in range(0, len(every), ASKED_CELLS):
                cells = every[i:i + ASKED_CELLS]
                for top in tops:
                    for group, members in _by_group(top[3][_leaf(top[:3], cells)]):
                        out.append((group, block, members.astype(np.uint16).tobytes(), cells[members].tobytes()))
                        size += len(members) * (d + 2)
                    if size > SENT_BYTES:
                        yield _sent(out, names, kinds)
                        out, size = [], 0
                block += 1
        if out:
            yield _sent(out, names, kinds)

    return rows


def _unpacked(table: pa.Table, row: int = 0) -> tuple[tuple, np.ndarray]:
    feature, split, value = (table.column(c)[row].as_py() for c in ("feature", "split", "value"))
    feature = np.frombuffer(feature, np.int8 if len(feature) == len(split) else np.int16).astype(np.int16)
    return (feature, np.frombuffer(split, np.uint8), _below(feature)), np.frombuffer(value, np.int64)


def _answered(first: set[int], d: int):
    """The values of a group's sets of bins; the groups ``first``, those of one tree, pass the sets on."""

    def answer(asked: pa.Table, subtree: pa.Table) -> pa.Table:
        cells, values = asked.column("cells").to_pylist(), [b""] * asked.num_rows
        if asked.num_rows and subtree.num_rows:
            top, known = _unpacked(subtree)
            joined = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, d)
            # A part at a time: walking down takes several numbers for each set.
            value = np.concatenate([known[top[2][_leaf(top, joined[i:i + PIECE_ROWS])]] for i in range(0, len(joined), PIECE_ROWS)])
            ends = np.cumsum([len(c) // d for c in cells])
            values = [value[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
        if asked.num_rows and asked.column("group")[0].as_py() not in first:
            cells = [b""] * asked.num_rows
        return pa.table({"block": asked.column("block"), "places": asked.column("places"), "cells": pa.array(cells, pa.binary()),
                         "value": pa.array(values, pa.binary())})

    return answer


def _scored(scale: float, d: int):
    """The mean of what the trees say of each set of bins of a block."""

    def score(table: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(x, kind) for x, kind in zip(row, (np.uint16, np.uint8, np.int64))]
                 for row in zip(*(table.column(c).to_pylist() for c in ("places", "cells", "value")))]
        n = 1 + max(int(places.max()) for places, _, _ in parts)
        cells, total, count = np.zeros((n, d), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for places, own, value in parts:
            if len(own):
                cells[places] = own.reshape(-1, d)
            if len(value):
                total[places] += value
                count[places] += 1
        known = np.flatnonzero(count)
        return pa.table({"_cell": _to_binary(cells[known]), "prediction": pa.array(total[known] / count[known] / scale)})

    return score


class DeepForest(Estimator):
    """Trees on ``_features``, split on all features; ``least`` rows at least on each side of a split."""

    def __init__(self, label: str, trees: int, depth: int, least: int, seed: int):
        super().__init__()
        self.label, self.trees, self.depth, self.least, self.seed = label, trees, depth, least, seed

    def _fit(self, dataset: DataFrame) -> "DeepForestModel":
        spark = dataset.sparkSession
        rows = dataset.select(vector_to_array("_features").alias("_x"), F.col(self.label).cast("double").alias("_y"))
        d = len(dataset.select("_features").first()[0]) if not dataset.isEmpty() else 0
        thresholds, _, top = _thresholds(rows, d)
        centre = rows.agg(F.avg("_y")).first()[0]
        # Rows of one set of bins come together; in order, so that numbers and draws do not depend on how they arrived.
        binned = rows.select(_bins_of(thresholds)("_x").alias("cell"), F.col("_y").alias("y")).hint("rebalance", "cell")
        data = checkpointed(binned.sortWithinPartitions("cell", "y").mapInArrow(_packed(d), BLOCKS))
        entries = data.agg(F.sum(F.octet_length("sizes") / 4)).first()[0]
        # Values are whole numbers of a fixed unit: sums are exact in any order, and those of all trees fit 62 bits.
        scale = 2.0 ** min(900, 61 - int(np.ceil(np.log2(max(self.trees, 2)))) - int(np.ceil(np.log2(top or 1.0))))
        tops, groups, leaves, gains = self._upper(data, d, entries, centre)
        trees, depths = [t for t, _ in groups], [p for _, p in groups]
        # Tasks of about one full group, and one for each core at least.
        tasks = min(len(groups), max(spark.sparkContext.defaultParallelism, int(entries * self.trees / GROUP_ROWS)))
        grown = (data.mapInArrow(_deal(tops, d, self.seed), DEALT).repartition(tasks, "group").groupBy("group")
                 .applyInArrow(_grown(trees, depths, d, self.least, scale), SUBTREES))
        path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
        grown.write.option("maxRecordsPerFile", FILE_SUBTREES).parquet(path)
        if leaves:
            single = [(g, t, np.full(1, -1, np.int16), np.zeros(1, np.uint8),
                       np.rint(np.array([v]) * scale).astype(np.int64), [0.0] * d) for g, t, v in leaves]
            spark.createDataFrame(_subtrees(single), SUBTREES).write.mode("append").parquet(path)
        share = spark.read.parquet(path).groupBy("tree").agg(*[F.sum(F.get("gains", F.lit(i))).alias(f"g{i}") for i in range(d)])
        for row in share.collect():
            gains[row["tree"]] += [row[f"g{i}"] for i in range(d)]
        total = gains.sum(axis=1, keepdims=True)
        mean = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)
        about = {"thresholds": thresholds, "tops": [[np.asarray(a).tolist() for a in t] for t in tops], "scale": scale,
                 "importances": (mean / (mean.sum() or 1.0)).tolist()}
        return DeepForestModel(about, path)

    def _upper(self, data: DataFrame, d: int, entries: float, centre: float):
        """The upper nodes of all trees; ``(tree, depth below)`` of each group; ``(group, tree, value)`` of large leaves; gains."""
        tree = [{"feature": [-1], "split": [0], "below": [0], "depth": [0]} for _ in range(self.trees)]
        waiting = [(t, 0) for t in range(self.trees)] if entries > GROUP_ROWS and self.depth else []
        large, gains = {}, np.zeros((self.trees, d))
        while waiting:
            now, waiting = sorted(waiting)[:ROUND_NODES], sorted(waiting)[ROUND_NODES:]
            active: dict[int, list[int]] = {}
            for t, node in now:
                active.setdefault(t, []).append(node)
            tops = {t: self._arrays(tree[t])[:3] for t in active}
            found = (data.mapInArrow(_sums(tops, active, d, centre, self.seed), SUMS).groupBy("tree", "node")
                     .applyInArrow(_best(d, self.least), BEST).collect())
            for best in sorted(found):
                t, node = tree[best["tree"]], best["node"]
                gains[best["tree"], best["feature"]] += best["gain"]
                t["feature"][node], t["split"][node], t["below"][node] = best["feature"], best["split"], len(t["feature"])
                large.pop((best["tree"], node), None)
                for side in ("left", "right"):
                    child, depth = len(t["feature"]), t["depth"][node] + 1
                    for name, value in (("feature", -1), ("split", 0), ("below", 0), ("depth", depth)):
                        t[name].append(value)
                    if best[f"rows_{side}"] > GROUP_ROWS:
                        # What no later round splits is a leaf.
                        large[best["tree"], child] = centre + best[f"sum_{side}"] / best[f"weight_{side}"]
                        if depth < self.depth:
                            waiting.append((best["tree"], child))
        groups, leaves, tops = [], [], []
        for number, t in enumerate(tree):
            group_of, dealt = [], []
            for node, feature in enumerate(t["feature"]):
                group_of.append(len(groups) if feature < 0 else -1)
                dealt.append(group_of[-1] if (number, node) not in large else -1)
                if feature < 0:
                    if dealt[-1] < 0:
                        leaves.append((len(groups), number, large[number, node]))
                    groups.append((number, self.depth - t["depth"][node]))
            tops.append((*self._arrays(t)[:3], np.array(dealt, np.int32), np.array(group_of, np.int32)))
        return tops, groups, leaves, gains

    @staticmethod
    def _arrays(tree: dict) -> tuple:
        return (np.array(tree["feature"], np.int16), np.array(tree["split"], np.uint8), np.array(tree["below"], np.int32))


class DeepForestModel(Model, MLWritable, MLReadable):
    """Upper nodes, thresholds and importances in the driver, subtrees in a folder that all executors reach."""

    def __init__(self, about: dict, path: str):
        super().__init__()
        self.about, self.path = about, path

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the built-in models name it so
        return Vectors.dense(self.about["importances"])

    def _tops(self) -> list[tuple]:
        kinds = (np.int16, np.uint8, np.int32, np.int32)
        return [tuple(np.array(a, k) for a, k in zip((t[0], t[1], t[2], t[4]), kinds)) for t in self.about["tops"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, tops, scale = len(self.about["thresholds"]), self._tops(), self.about["scale"]
        cell = _bins_of(self.about["thresholds"])(vector_to_array("_features"))
        if dataset.isStreaming:
            return dataset.withColumn("prediction", self._whole()(cell))
        celled = dataset.withColumn("_cell", cell)
        # In order, so that a task that runs again makes the same blocks.
        cells = celled.select(F.col("_cell").alias("cell")).distinct().sortWithinPartitions("cell")
        asked = cells.mapInArrow(_asked(tops, d), ASKED)
        subtrees = dataset.sparkSession.read.parquet(self.path).drop("gains")
        values = (asked.groupBy("group").cogroup(subtrees.groupBy("group"))
                  .applyInArrow(_answered(set(tops[0][3].tolist()), d), ANSWERED).groupBy("block")
                  .applyInArrow(_scored(scale, d), "_cell binary, prediction double"))
        return celled.join(values, "_cell", "left").select(*dataset.columns, "prediction")

    def _whole(self):
        """The whole model in every task, for streams, which can neither be dealt nor met twice."""
        d, tops, scale = len(self.about["thresholds"]), self._tops(), self.about["scale"]
        table = self._sparkless(SparkSession.active().read.parquet(self.path).drop("gains").toArrow())

        @F.arrow_udf("double")
        def predicted(cell: pa.Array) -> pa.Array:
            cells = _from_binary(cell, d)
            total, count = np.zeros(len(cells), np.int64), np.zeros(len(cells))
            for top in tops:
                for group, members in _by_group(top[3][_leaf(top[:3], cells)]):
                    if group in table:
                        below, values = table[group]
                        total[members] += values[below[2][_leaf(below, cells[members])]]
                        count[members] += 1
            return pa.array(total / count / scale)

        return predicted

    @staticmethod
    def _sparkless(table: pa.Table) -> dict:
        return {g.as_py(): _unpacked(table, i) for i, g in enumerate(table.column("group"))}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"about": json.dumps(self.model.about)})
        spark.read.parquet(self.model.path).write.option("maxRecordsPerFile", FILE_SUBTREES).parquet(f"{path}/subtrees")


class _Reader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        """The model as it is now: a later one may replace the folder, as it does for models kept in memory."""
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        own = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
        spark.read.parquet(f"{path}/subtrees").write.option("maxRecordsPerFile", FILE_SUBTREES).parquet(own)
        model = DeepForestModel(json.loads(metadata["about"]), own)
        model._resetUid(metadata["uid"])
        return model
