"""Joining a per-key table to a big table without trusting that it is small."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.session import checkpointed, held

# A table is broadcast only after it was measured to be below both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SALTS = 64


def materialise_small(df: DataFrame) -> tuple[DataFrame, bool]:
    """Compute ``df`` once and say whether it is proven small.

    Rows and bytes are counted on the executors first; only a table below both bounds reaches the driver. A table found to be larger is written to
    the checkpoint folder, so that the joins that follow do not compute it again.
    """
    with held(df.limit(BROADCAST_ROWS + 1)) as head:
        texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
        sizes = [F.sum(F.octet_length(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(texts)]
        size = head.agg(F.count("*").alias("n"), *sizes).first()
        # Texts by their measured length, other values at 16 bytes each.
        total = sum(size[f"_{i}"] or 0 for i in range(len(texts))) + 16 * size["n"] * len(df.columns)
        if size["n"] <= BROADCAST_ROWS and total <= BROADCAST_BYTES:
            return df.sparkSession.createDataFrame(head.toArrow(), schema=df.schema), True
    return checkpointed(df), False


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], salt_on: list[str] | None = None,
                how: str = "left") -> DataFrame:
    """Join ``table``, which has one row per key, to ``big``.

    A table proven small is broadcast, so a hot key costs nothing. Any other is joined by a
    shuffle on the key and a salt, with ``table`` repeated once per salt: a key that holds a
    third of ``big`` is spread over ``SALTS`` tasks. The salt is a hash of row values, so a
    stage that is run again gives every row the same salt.
    """
    table, small = materialise_small(table)
    return join_materialised(big, table, small, on, salt_on, how)


def join_materialised(big: DataFrame, table: DataFrame, small: bool, on: list[str],
                      salt_on: list[str] | None = None, how: str = "left") -> DataFrame:
    """``lookup_join`` for a table that ``materialise_small`` has already computed."""
    renamed = table.withColumnsRenamed({k: f"_key_{k}" for k in on})
    match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in on]
    drop = [f"_key_{k}" for k in on]
    if small:
        condition = reduce(lambda a, b: a & b, match)
        return big.join(F.broadcast(renamed), condition, how).drop(*drop)
    salt = F.pmod(F.xxhash64(*(salt_on or big.columns)), F.lit(SALTS))
    salted = big.withColumn("_salt", salt)
    repeated = renamed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    condition = reduce(lambda a, b: a & b, match, F.col("_salt") == F.col("_copy"))
    return salted.join(repeated, condition, how).drop(*drop, "_salt", "_copy")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the values of a global aggregate, one row by construction, on every row."""
    return df.crossJoin(F.broadcast(one_row))
