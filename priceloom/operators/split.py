"""A train/test split that depends on the key alone, not on how the data is partitioned."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.schema import KEY

IS_TEST = "is_test"


def key_number(key: Column, salt: str = "") -> Column:
    """32 bits of a hash of the key."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def fold_of(key: Column, folds: int, salt: str = "") -> Column:
    """One of ``folds`` shares, numbered from 0, that a key belongs to."""
    return (key_number(key, salt) % folds).cast("int")


def in_test(key: Column, test_size: float = 0.2, salt: str = "") -> Column:
    """True for about ``test_size`` of all keys, to 32 bits; another ``salt`` gives another split."""
    return key_number(key, salt) < F.lit(test_size * 2**32)


def with_split(df: DataFrame, key: str = KEY, test_size: float = 0.2, salt: str = "") -> DataFrame:
    """Add the boolean column ``is_test``."""
    return df.withColumn(IS_TEST, in_test(F.col(key), test_size, salt))
