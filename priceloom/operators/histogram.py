"""Fixed-width histograms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scalars import bounded
from priceloom.operators.quantile import column_quantiles, quantile_row
from priceloom.session import held

HISTOGRAM_SCHEMA = "bin bigint, bin_start double, bin_end double, count bigint"


def _edges(start: float, end: float, bins: int) -> list[float]:
    """Bin edges; a single value is widened by 0.5 on each side."""
    if start == end:
        start, end = start - 0.5, end + 0.5
    return [start + i * ((end - start) / bins) for i in range(bins)] + [end]


def _bin_of(x: Column, edges: list[float]) -> Column:
    """The bin of ``x``. The quotient may land one bin off at an edge, so it is checked against the edges."""
    bins, start, end = len(edges) - 1, edges[0], edges[-1]
    step = (end - start) / bins
    guess = F.least(F.floor((x - start) / step), F.lit(bins - 1))

    def edge(number):
        return F.when(number == bins, F.lit(end)).otherwise(F.lit(start) + number * step)

    down = (x < edge(guess)).cast("long")
    up = ((x >= edge(guess + 1)) & (guess < bins - 1)).cast("long")
    return guess - down + up


def _rows(edges: list[float], counts: dict) -> list[tuple]:
    return [(i, edges[i], edges[i + 1], counts.get(i, 0)) for i in range(len(edges) - 1)]


def histogram(df: DataFrame, column: str, bins: int = 40, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Equal-width bins over the column's range: ``(bin, bin_start, bin_end, count)``.

    Bins are closed on the left, the last one on both sides; empty bins are kept. A constant
    column is widened by 0.5 on each side. No rows give no bins. ``low`` and ``high`` are
    quantiles at which the column is clipped first.

    The result is computed at once. Both passes are combined before the shuffle, which carries at
    most ``bins`` rows per task.
    """
    x = F.col(column).cast("double")
    data = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    with held(data) as data:
        if low is None and high is None:
            limits = data.agg(F.min("_x").alias("low"), F.max("_x").alias("high")).first()
        else:
            limits = quantile_row(data, "_x", {"low": low or 0.0, "high": 1.0 if high is None else high}).first()
        start, end = limits["low"], limits["high"]
        if start is None:
            return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
        edges = _edges(start, end, bins)
        clipped = data.select(bounded(F.col("_x"), F.lit(start), F.lit(end)).alias("_x"))
        counted = clipped.groupBy(_bin_of(F.col("_x"), edges).alias("bin")).agg(F.count("*").alias("count"))
        counts = {row["bin"]: row["count"] for row in counted.collect()}
    return df.sparkSession.createDataFrame(_rows(edges, counts), HISTOGRAM_SCHEMA)


def feature_histograms(df: DataFrame, columns: list[str], bins: int = 40, high: float = 0.98) -> DataFrame:
    """One histogram per column, each clipped at an upper quantile: ``(Feature, bin, …, count)``.

    All columns are counted in the same pass.
    """
    with held(df.select(*[F.col(c).cast("double").alias(c) for c in columns])) as data:
        limits = {c: {} for c in columns}
        for row in column_quantiles(data, columns, [0.0, high]).collect():
            limits[row["Feature"]][row["prob"]] = row["value"]
        edges = {c: _edges(q[0.0], q[high], bins) for c, q in limits.items() if q}
        cells = []
        for c in edges:
            clipped = bounded(F.col(c), F.lit(limits[c][0.0]), F.lit(limits[c][high]))
            valid = F.col(c).isNotNull() & ~F.isnan(c)
            cells.append(F.struct(F.lit(c).alias("Feature"), F.when(valid, _bin_of(clipped, edges[c])).alias("bin")))
        counts = {c: {} for c in edges}
        if cells:
            binned = data.select(F.inline(F.array(*cells))).where("bin is not null")
            for row in binned.groupBy("Feature", "bin").agg(F.count("*").alias("count")).collect():
                counts[row["Feature"]][row["bin"]] = row["count"]
    rows = [(c, *row) for c in edges for row in _rows(edges[c], counts[c])]
    return df.sparkSession.createDataFrame(rows, f"Feature string, {HISTOGRAM_SCHEMA}")
