"""A dense 0-based row number in key order, without a one-task window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceloom.session import checkpointed

_IN_PARTITION = (1 << 33) - 1


def with_ordinal(df: DataFrame, order_by: list, name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of ``order_by``, which should be unique.

    The rows are range-sorted once and checkpointed, which fixes their partitions. A row's
    number is then its place in its partition plus the sizes of the partitions before it. Only
    the table of partition sizes (one row per partition) is ordered in one task and broadcast.
    """
    ordered = checkpointed(df.orderBy(*order_by))
    placed = ordered.withColumn("_place", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_place", 33)
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_place").bitwiseAND(F.lit(_IN_PARTITION))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_place", "_offset")


def with_running_total(df: DataFrame, order_by: str, amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` in the order of a unique column, partition by partition."""
    ordered = checkpointed(df.orderBy(order_by)).withColumn("_part", F.spark_partition_id())
    sums = ordered.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_offset") + F.sum(amount).over(inside)
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, total).drop("_part", "_offset")
