"""The registered queries and, where SQL can say the same, the SQL to check them with."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function under a name."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that sums taken in another order compare equal."""
    return df.select(*[r(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`")
                       for c, kind in df.dtypes])


def r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def q(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


def shown(expression: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a double."""
    return f"cast(round(cast(cast({expression} as varchar) as decimal(38, 17)), {digits}) as double)"
