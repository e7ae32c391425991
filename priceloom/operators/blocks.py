"""Compare every row of one table with every row of another in bounded blocks, as one planned job."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.session import checkpointed

#: Rows that a block holds on average, and at most twice.
LEFT_ROWS = 4096
RIGHT_ROWS = 8192
#: Partitions of the right side: so many at least, more for a left side of few blocks, so that there are this many
#: tasks, and more where one would hold more than so many blocks.
RIGHT_PARTS = 16
TASKS = 256
BLOCKS_IN_PART = 64


def blocks_of(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def parts_of(lefts: int, rights: int) -> int:
    """Partitions into which the blocks of the right side are dealt."""
    wanted = max(RIGHT_PARTS, blocks_of(TASKS, lefts), blocks_of(rights, BLOCKS_IN_PART))
    return min(rights, wanted)


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """One row per block, its rows as compressed Arrow bytes; written once, which fixes the partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block():
            nonlocal place
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                for part in waiting:
                    out.write_batch(part)
            place += 1
            return pa.RecordBatch.from_pydict({f"{name}_id": pa.array([first + place - 1], pa.int64()),
                                               name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        first, place, waiting, held = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, 2 * rows - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held == 2 * rows:
                    yield block()
                    waiting, held = [], 0
        if held:
            yield block()

    return checkpointed(df.mapInArrow(pack, f"{name}_id long, {name} binary"))


def compare_blocks(left: DataFrame, right: DataFrame, compare: Callable[[pa.Table, pa.Table, pa.Table | None], pa.Table],
                   schema, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS,
                   *, number: str | None = None) -> DataFrame:
    """Call ``compare(left block, right block, found so far)`` for every pair of blocks and unite what it returns.

    Rows are dealt evenly into blocks, which are written once; ``number`` names a column that then numbers the left
    rows. A task reads some blocks of the left side and meets each with the blocks of one partition of the right
    side, one after the other: ``compare`` gets what it returned for the left block before, or None, and the last
    result counts. No copy of a row is shuffled or written, however many blocks the other side has: both grow with
    the rows alone, only reading and comparing grow with the product. The right side has a bounded number of
    partitions while their blocks fit a task, so a summary such as the best few rows per left row is returned that
    often. Nothing passes the driver but two counts.
    """
    lefts, rights = blocks_of(left.count(), left_rows), blocks_of(right.count(), right_rows)
    dealt = left.repartition(lefts)
    if number:
        dealt = dealt.withColumn(number, F.monotonically_increasing_id())
    a = _packed(dealt, left_rows, "left")
    b = _packed(right.repartition(parts_of(lefts, rights)), right_rows, "right")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block = found = None
        for batch in batches:
            columns = [batch.column(n) for n in ("left_id", "left", "right")]
            for i in range(batch.num_rows):
                if columns[0][i].as_py() != at:
                    if found is not None:
                        yield from found.combine_chunks().to_batches()
                    at, block, found = columns[0][i].as_py(), _unpacked(columns[1][i]), None
                found = compare(block, _unpacked(columns[2][i]), found)
        if found is not None:
            yield from found.combine_chunks().to_batches()

    pairs = a.crossJoin(b.hint("shuffle_replicate_nl").select("right"))
    return pairs.mapInArrow(meet, schema)


def _unpacked(block: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()
