"""Training statistics: one (feature, mean, std) row per feature, whole or merged from batches."""

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATS_SCHEMA = "feature string, mean double, std double"
STATE_SCHEMA = "feature string, n long, mean double, m2 double, batch string"


def write_stats(stats: DataFrame, path: str, kind: str = "json") -> None:
    """One small file: the table has one row per feature."""
    stats.coalesce(1).write.mode("overwrite").format(kind).save(path)


def read_stats(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).format(kind).load(path)


def display_stats(stats: DataFrame) -> DataFrame:
    """The table under its display names."""
    return stats.select("feature", F.col("mean").alias("Mean"), F.col("std").alias("Std Dev"))


def add_batch(df: DataFrame, features: list[str], path: str, batch_id) -> None:
    """Write count, mean and sum of squared deviations of a batch, in one scan; null values do not count.

    The state has a folder per batch, so a batch that comes again replaces itself. While it is replaced, readers
    do not see it. An empty batch adds nothing to the merged statistics.
    """
    name = quote(str(batch_id), safe="")
    if not name:
        raise ValueError("a batch needs an id")
    moments = []
    for i, f in enumerate(features):
        value = F.col(f"`{f}`").cast("double")
        moments += [F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}"), F.var_pop(value).alias(f"var{i}")]
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"mean{i}").alias("mean"),
                      (F.col(f"var{i}") * F.col(f"n{i}")).alias("m2")) for i, f in enumerate(features)]
    state = df.agg(*moments).select(F.inline(F.array(*cells)))
    state.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={name}")


def merged_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all batches together: only their few state rows are read, never the batches.

    Deviations are moved to the common mean before they are added, which keeps large values with a small spread
    exact. A feature without a value has null statistics.
    """
    state = spark.read.schema(STATE_SCHEMA).parquet(path)
    feature = Window.partitionBy("feature")
    total = F.nullif(F.sum("n").over(feature), F.lit(0).cast("long"))
    moved = state.withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(feature) / total)
    apart = F.col("mean") - F.col("centre")
    merged = moved.groupBy("feature").agg(F.sum("n").alias("n"), F.max("centre").alias("mean"),
                                          F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))
    std = F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1))
    return merged.select("feature", "mean", std.alias("std"))
