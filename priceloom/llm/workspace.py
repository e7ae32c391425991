"""Tables between the phases of an operator, in the folder that all executors share."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from priceloom.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most rows of an Arrow batch that holds whole texts.
TEXT_BATCH = 1000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _shuffles_end_with_the_query(spark: SparkSession):
    """Shuffle files of the queries that run here are removed when the query that wrote them ends."""
    return _setting(spark, _CLEANUP, "true")


def text_batches(spark: SparkSession):
    """Queries that run here hand texts to Python in small batches, which bounds the memory of both sides."""
    now = int(spark.conf.get(_BATCH))
    return _setting(spark, _BATCH, str(min(now, TEXT_BATCH) if now > 0 else TEXT_BATCH))


class Shelf:
    """Named Parquet tables of one run of an operator: compressed cuts of the lineage.

    ``put`` writes a table and reads it again; the shuffle files of that phase go when it ends. ``drop``
    empties tables whose successors are written, so that disk is bounded by the tables still in use.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4()}"
        self.schemas = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        with _shuffles_end_with_the_query(self.spark):
            df.write.parquet(path)
        self.schemas[name] = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Overwrite tables with empty ones. Nothing that reads them may run any more."""
        for name in names:
            empty = self.spark.createDataFrame([], self.schemas[name])
            empty.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again."""
    return Shelf(df.sparkSession).put("table", df)
