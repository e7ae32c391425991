"""Which documents models learn from."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """Held out from learning: remainder 2. A null id is not held out, and not learned from either."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))
