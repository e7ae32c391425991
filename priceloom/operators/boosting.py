"""Boosted trees of bounded depth, fitted by passes over packed rows.

The built-in learner keeps every row as several objects and its residual as another, which each tree makes anew. Here
features are cut into bins. Rows of one set of bins fall into one leaf of every tree, so they are one entry, with their
number and the sum of what the trees so far leave of their targets; entries are packed in blocks, a byte per bin and two
numbers. All tasks sum up their blocks by node and bin, once for each level of a tree, and only the chosen splits reach
the driver. The trees are those of the built-in learner: the first counts in full, and each later one is fitted to twice
the residual, the gradient of the squared error, and counts by the rate.
"""

from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.operators.forest import BEST, BINS, SUMS, _best, _bins_of, _from_binary, _stretches, _thresholds
from priceloom.session import checkpointed

#: Entries in a block, and in a task of a pass at most.
BLOCK_ROWS, TASK_ROWS = 1 << 16, 1 << 22
#: Residuals follow from those before the last tree, and after so many trees from the target again, which keeps lineage short.
CHAINED = 25
#: The driver adds up the sums of a level, a few numbers per node and bin from each task, if all take no more bytes.
DRIVER_BYTES = 16 << 20
#: A tree with more inner nodes is walked level by level, others node by node.
FEW_NODES = 40

BLOCKS = "cells binary, residual binary, weight binary"
TREES = "tree int, feature array<int>, split array<int>, below array<int>, value array<double>"


class Tree(NamedTuple):
    """Nodes, parents first: feature asked for (-1 in a leaf), last bin of the left side, left child, what a leaf adds."""

    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray
    value: np.ndarray


def _place(tree: Tree, cells: np.ndarray) -> np.ndarray:
    """The node that each row comes to; ``cells`` holds the rows' bins feature by feature."""
    at = np.zeros(cells.shape[1], np.uint16)
    inner = np.flatnonzero(tree.feature >= 0).tolist()
    if len(inner) <= FEW_NODES:
        for node in inner:
            right = cells[tree.feature[node]] > tree.split[node]
            np.copyto(at, right + np.uint16(tree.below[node]), where=at == node)
        return at
    every = np.arange(len(at))
    while len(every):
        every = every[tree.feature[at[every]] >= 0]
        node = at[every]
        at[every] = tree.below[node] + (cells[tree.feature[node], every] > tree.split[node])
    return at


def _packed(d: int):
    """Blocks of entries ``(cell, total, n)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches):
            cells, total, n = _from_binary(batch.column("cell"), d), batch.column("total").to_numpy(), batch.column("n").to_numpy()
            for i in range(0, len(n), BLOCK_ROWS):
                j = i + BLOCK_ROWS
                yield _block(np.ascontiguousarray(cells[i:j].T), total[i:j], n[i:j])

    return rows


def _block(cells: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
    columns = (cells, *numbers)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["cells", "residual", "weight"][:len(columns)])


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins feature by feature and the numbers of each block."""
    for batch in batches:
        for cells, *numbers in zip(*batch.columns):
            yield np.frombuffer(cells.as_buffer(), np.uint8).reshape(d, -1), *(np.frombuffer(x.as_buffer()) for x in numbers)


def _after(trees: list[Tree], d: int):
    """Blocks with what some more trees leave."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, residual, weight in _blocks(batches, d):
            left = residual.copy()
            for tree in trees:
                left -= tree.value[_place(tree, cells)] * weight
            yield _block(cells, left, weight)

    return rows


def _sums(number: int, tree: Tree, active: list[int], d: int):
    """Of each active node, rows and residuals by feature and bin."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of other nodes count in a slot of their own.
        slots, seen = len(active) + 1, False
        slot = np.full(len(tree.feature), len(active), np.int64)
        slot[active] = np.arange(len(active))
        total = np.zeros((2, slots, d, BINS))
        for cells, residual, weight in _blocks(batches, d):
            seen, first = True, (slot * BINS)[_place(tree, cells)]
            for f in range(d):
                index = first + cells[f]
                for k, values in enumerate((weight, residual)):
                    total[k, :, f] += np.bincount(index, values, slots * BINS).reshape(-1, BINS)
        if seen:
            n = len(active)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(number, pa.int32()), n), pa.array(active, pa.int32()),
                 pa.repeat(pa.scalar(TaskContext.get().partitionId(), pa.int64()), n),
                 pa.array([total[:, i].tobytes() for i in range(n)], pa.binary())], ["tree", "node", "part", "sums"])

    return rows


class BoostedTrees(Estimator):
    """``trees`` trees on ``_features``, split on all features."""

    def __init__(self, label: str, trees: int, rate: float, depth: int):
        super().__init__()
        self.label, self.trees, self.rate, self.depth = label, trees, rate, depth

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        rows = dataset.select(vector_to_array("_features").alias("_x"), F.col(self.label).cast("double").alias("_y"))
        d = len(dataset.select("_features").first()[0]) if not dataset.isEmpty() else 0
        thresholds, _, _ = _thresholds(rows, d)
        centre = rows.agg(F.avg("_y")).first()[0]
        binned = rows.select(_bins_of(thresholds)("_x").alias("cell"), (F.col("_y") - centre).alias("y"))
        entries = binned.groupBy("cell").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("n"))
        packed = checkpointed(entries.mapInArrow(_packed(d), BLOCKS))
        n = int(packed.agg(F.sum(F.octet_length("weight") / 8)).first()[0])
        tasks = max(min(dataset.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)), -(-n // TASK_ROWS))
        base = checkpointed(packed.repartition(tasks))
        trees, gains, left, before = [], np.zeros(d), None, None
        try:
            for number in range(self.trees):
                before = left
                more = trees[-1:] if number % CHAINED else trees
                left = (before if number % CHAINED else base).mapInArrow(_after(more, d), BLOCKS)
                left.persist(StorageLevel.MEMORY_AND_DISK)
                tree, gain = self._grow(left, number, d, tasks)
                trees.append(tree)
                gains += gain
                if before is not None:
                    before, _ = None, before.unpersist()
        finally:
            for kept in (before, left):
                if kept is not None:
                    kept.unpersist()
        return BoostedTreesModel(thresholds, centre, (gains / (gains.sum() or 1.0)).tolist(), trees)

    def _grow(self, left: DataFrame, number: int, d: int, tasks: int) -> tuple[Tree, np.ndarray]:
        """The next tree, and its gains by feature."""
        step, scale = (2 * self.rate, 4.0) if number else (1.0, 1.0)
        # A root that no split helps adds nothing: residuals have a mean of zero.
        nodes, active, gains = [[-1, 0, 0, 0.0]], [0], np.zeros(d)
        for _ in range(self.depth):
            sums = left.mapInArrow(_sums(number, self._tree(nodes), active, d), SUMS)
            if tasks * len(active) * d * 16 * BINS <= DRIVER_BYTES:
                table = sums.toArrow()
                key = pa.scalar(number, pa.int32())
                parts = [_best(d, 1)((key, pa.scalar(n, pa.int32())), table.filter(pc.field("node") == n)) for n in active]
                found = pa.concat_tables(parts).to_pylist()
            else:
                found = [row.asDict() for row in sums.groupBy("tree", "node").applyInArrow(_best(d, 1), BEST).collect()]
            active = []
            for best in sorted(found, key=itemgetter("node")):
                gains[best["feature"]] += scale * best["gain"]
                nodes[best["node"]] = [best["feature"], best["split"], len(nodes), 0.0]
                for side in ("left", "right"):
                    if best[f"weight_{side}"] > 1:
                        active.append(len(nodes))
                    nodes.append([-1, 0, 0, step * best[f"sum_{side}"] / best[f"weight_{side}"]])
            if not active:
                break
        return self._tree(nodes), gains

    @staticmethod
    def _tree(nodes: list[list]) -> Tree:
        return Tree(*(np.array(x, kind) for x, kind in zip(zip(*nodes), (np.int16, np.uint8, np.uint16, np.float64))))


class BoostedTreesModel(Model, MLWritable, MLReadable):
    """Thresholds and trees, whose number and depth bound their size."""

    def __init__(self, thresholds: list[list[float]], centre: float, importances: list[float], trees: list[Tree]):
        super().__init__()
        self.thresholds, self.centre, self.importances, self.trees = thresholds, centre, importances, trees

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the built-in models name it so
        return Vectors.dense(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, centre, trees = len(self.thresholds), self.centre, self.trees

        @F.arrow_udf("double")
        def predicted(cell: pa.Array) -> pa.Array:
            cells = np.ascontiguousarray(_from_binary(cell, d).T)
            total = np.full(len(cell), centre)
            for tree in trees:
                total += tree.value[_place(tree, cells)]
            return pa.array(total)

        return dataset.withColumn("prediction", predicted(_bins_of(self.thresholds)(vector_to_array("_features"))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        model, spark = self.model, self.sparkSession
        about = {"thresholds": model.thresholds, "centre": model.centre, "importances": model.importances}
        DefaultParamsWriter.saveMetadata(model, path, spark, about)
        rows = [(i, *(x.tolist() for x in tree)) for i, tree in enumerate(model.trees)]
        spark.createDataFrame(rows, TREES).coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()
        kinds = (np.int16, np.uint8, np.uint16, np.float64)
        trees = [Tree(*(np.array(x, kind) for x, kind in zip(row[1:], kinds))) for row in rows]
        model = BoostedTreesModel(metadata["thresholds"], metadata["centre"], metadata["importances"], trees)
        model._resetUid(metadata["uid"])
        return model
