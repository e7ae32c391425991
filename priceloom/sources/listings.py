"""Reading and writing listing tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.schema import RAW_COLUMNS
from priceloom.sources.csv_ranges import read_csv_ranges


#: A file of more bytes is read by many tasks, also where quoted fields hold line breaks.
RANGE_BYTES = 128 << 20


def _largest_file(spark: SparkSession, path: str) -> int:
    """From the listing of the files alone; their content is not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def read_listings_csv(spark: SparkSession, path: str, multiline: bool = True, ranges: bool | None = None) -> DataFrame:
    """Raw listings from CSV with a header, every column a string; columns beyond the known ones are kept.

    Types are never inferred: only the header line is read ahead. Quoted fields may hold line
    breaks: a file of up to ``RANGE_BYTES`` is one task then, and if there is a larger one, records are cut
    by byte ranges (``csv_ranges``), which ``ranges`` asks for or rules out at any size. Both give the same rows.
    ``multiline=False`` saves the scan that this takes for files without such breaks. A missing path and a
    missing column both fail at once.
    """
    if multiline and (ranges if ranges is not None else _largest_file(spark, path) > RANGE_BYTES):
        df = read_csv_ranges(spark, path)
    else:
        reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
        df = reader.option("multiLine", multiline).csv(path)
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in {path}: {', '.join(missing)}")
    return df


def write_listings(df: DataFrame, path: str) -> None:
    """Clean listings as Parquet: clean once, then let every reader prune columns and push filters."""
    df.write.mode("overwrite").parquet(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
