"""Published versions: what is written under a name is whole before a reader can find it.

A version is written to a folder of its own; then one row that names it is appended to the small table of
publications, as one file that appears at once. Readers take the last row, so they see the old version or the
new one, and a writer that fails in between leaves the old one in place. One writer per name at a time.
"""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_PUBLICATION = "number long, version string"


def _root(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _last(spark: SparkSession, folder: str, name: str):
    try:
        published = spark.read.schema(_PUBLICATION).json(f"{_root(folder, name)}/published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return published.agg(F.max(F.struct("number", "version")).alias("last")).first()["last"]


def publish(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current version; returns the version."""
    version = uuid.uuid4().hex
    write(f"{_root(folder, name)}/{version}")
    last = _last(spark, folder, name)
    row = [((last["number"] if last else 0) + 1, version)]
    spark.createDataFrame(row, _PUBLICATION).coalesce(1).write.mode("append").json(f"{_root(folder, name)}/published")
    return version


def current_version(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """``(version, path)`` of the last publication; fails with FileNotFoundError when there is none."""
    last = _last(spark, folder, name)
    if last is None:
        raise FileNotFoundError(f"nothing is published at {_root(folder, name)}")
    return last["version"], f"{_root(folder, name)}/{last['version']}"
