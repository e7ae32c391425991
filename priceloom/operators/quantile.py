"""Exact quantiles with linear interpolation, for columns and groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here the
wanted order statistics are narrowed down by counting: values are counted in bins, the bin that
holds each wanted rank is found from the running count, and only that bin is looked at more
closely. Every pass is a partial aggregation; what is shuffled is bin counts, never the rows of
a hot group.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scalars import bounded
from priceloom.operators.joins import join_materialised, lookup_join, materialise_small, with_scalars
from priceloom.session import held

BINS_PER_OCTAVE = 128
REFINE_BINS = 4096
# The rows of a bin are sorted in one task when there are at most this many.
SORT_ROWS = 100_000

# A bin number that rises with the value and needs no knowledge of the data.
_FIRST_BIN = f"""case when _v = 0 then 0D when abs(_v) = double('infinity') then sign(_v) * 1e9D
    else sign(_v) * (1e6D + floor(log2(abs(_v)) * {BINS_PER_OCTAVE})) end"""

# An equal-width bin in [_from, _to]. Both ends have a bin of their own, so bins always shrink.
_CLOSER_BIN = f"""case when _v <= _from then 0 when _v >= _to then {REFINE_BINS - 1}
    when _to - _from = double('infinity') then 1
    else 1 + floor(least((_v - _from) / (_to - _from), 1D) * {REFINE_BINS - 3}) end"""


def exact_quantiles(df: DataFrame, column: str, probs: list[float], by: tuple = ()) -> DataFrame:
    """One row per group and probability: ``(*by, prob, value)``. Nulls and NaN are skipped.

    The result is computed at once: its passes share one narrow copy of the column.
    """
    by = list(by)
    keys = by or ["_all"]
    value = F.col(column).cast("double").alias("_v")
    data = df.select(*(by or [F.lit(0).alias("_all")]), value).where("_v is not null and not isnan(_v)")
    with held(data) as data:
        found, _ = materialise_small(_search(data, keys, [float(p) for p in probs]))
    return found.select(*by, "prob", "value")


def column_quantiles(wide: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """``(Feature, prob, value)`` for several columns of a table that the caller holds.

    The columns are unpivoted anew in every pass, below the partial aggregation, so no long form is kept.
    """
    doubles = wide.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], columns, "Feature", "_v").where("_v is not null and not isnan(_v)")
    return materialise_small(_search(long, ["Feature"], [float(p) for p in probs]))[0]


def _search(data: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    names = [f"`{k}`" for k in keys]
    group = ", ".join(names)
    listed = ", ".join(f"{p!r}D" for p in probs)
    counts = data.groupBy(*keys, F.expr(_FIRST_BIN).alias("_bin")).agg(
        F.expr("count(*)").alias("_n"), F.expr("min(_v)").alias("_lo"), F.expr("max(_v)").alias("_hi"))
    # Every probability asks for the values at the ranks below and above its place.
    targets = counts.selectExpr(
        *names, "_n", "_lo", "_hi", f"sum(_n) over (partition by {group} order by _bin) - _n as _base",
        f"sum(_n) over (partition by {group}) as _total",
    ).selectExpr(
        *names, "_n", "_lo", "_hi", "_base",
        f"""explode(flatten(transform(transform(array({listed}), p -> p * (_total - 1)), (x, i) -> array(
            struct(i as _i, 0 as _side, floor(x) as _rank, x - floor(x) as _part),
            struct(i as _i, 1 as _side, ceil(x) as _rank, x - floor(x) as _part))))) as _want""",
    ).selectExpr(*names, "_want.*", "_n", "_lo", "_hi", "_base").where("_rank >= _base and _rank < _base + _n")
    targets, small = materialise_small(targets)

    open_bin, wide = "_lo < _hi", f"_lo < _hi and _n > {SORT_ROWS}"
    widest = F.expr(f"max(if({open_bin}, _n, null))")
    largest = targets.agg(widest).first()[0]
    while largest is not None and largest > SORT_ROWS:
        closer = _closer(data, targets.where(wide), small, keys)
        targets, small = materialise_small(closer.unionByName(targets.where(f"not ({wide})")))
        largest = targets.agg(widest).first()[0]
    if largest is not None:
        targets = _sorted(data, targets.where(open_bin), small, keys).unionByName(targets.where(f"not ({open_bin})"))

    # Equal neighbours are taken as they are, which also keeps infinite values from giving NaN.
    return targets.groupBy(*keys, "_i").agg(
        F.expr("max(if(_side = 0, _lo, null))").alias("_below"), F.expr("max(if(_side = 1, _lo, null))").alias("_above"),
        F.expr("max(_part)").alias("_part"),
    ).selectExpr(*names, f"element_at(array({listed}), _i + 1) as prob",
                 "if(_below = _above, _below, _below + (_above - _below) * _part) as value")


def _inside(data: DataFrame, targets: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    """The rows that lie in a target's bin, with the bin's ends."""
    names = [f"`{k}`" for k in keys]
    bounds = targets.groupBy(*keys).agg(F.expr("collect_set(struct(_lo, _hi))").alias("_bounds"))
    joined = join_materialised(data, bounds, small, keys, how="inner")
    picked = joined.selectExpr(*names, "_v", "explode(filter(_bounds, b -> _v >= b._lo and _v <= b._hi)) as _b")
    return picked.selectExpr(*names, "_v", "_b._lo as _from", "_b._hi as _to")


def _matching(targets: DataFrame, bins: DataFrame, keys: list[str], condition: str = "true") -> DataFrame:
    """Targets with what was found out about their bins."""
    same = " and ".join(f"`{k}` <=> `_c_{k}`" for k in keys)
    renamed = bins.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    return targets.join(renamed, F.expr(f"{same} and _lo = _from and _hi = _to and {condition}"))


def _closer(data: DataFrame, targets: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    """Cut the targets' bins into smaller ones, and give each target the one that holds its rank."""
    names = [f"`{k}`" for k in keys]
    counts = _inside(data, targets, small, keys).groupBy(*keys, "_from", "_to", F.expr(_CLOSER_BIN).alias("_bin")).agg(
        F.expr("count(*)").alias("_m"), F.expr("min(_v)").alias("_min"), F.expr("max(_v)").alias("_max"))
    group = ", ".join([*names, "_from", "_to"])
    counts = counts.selectExpr(
        *names, "_from", "_to", "_m", "_min", "_max", f"sum(_m) over (partition by {group} order by _bin) - _m as _before")
    held_rank = "_rank >= _base + _before and _rank < _base + _before + _m"
    return _matching(targets, counts, keys, held_rank).selectExpr(
        *names, "_i", "_side", "_rank", "_part", "_m as _n", "_min as _lo", "_max as _hi", "_base + _before as _base")


def _sorted(data: DataFrame, targets: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    """Resolve targets whose bins hold at most ``SORT_ROWS`` rows."""
    names = [f"`{k}`" for k in keys]
    values = _inside(data, targets, small, keys).groupBy(*keys, "_from", "_to").agg(
        F.expr("sort_array(collect_list(_v))").alias("_values"))
    found = _matching(targets, values, keys).selectExpr(
        *names, "_i", "_side", "_rank", "_part", "_base", "_values[cast(_rank - _base as int)] as _value")
    return found.selectExpr(
        *names, "_i", "_side", "_rank", "_part", "1L as _n", "_value as _lo", "_value as _hi", "_base")


def quantile_row(df: DataFrame, column: str, named: dict[str, float]) -> DataFrame:
    """One row with one column per named probability; nulls for an empty input."""
    long = exact_quantiles(df, column, list(named.values()))
    return long.agg(*[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(name)
                      for name, p in named.items()])


def clip_upper(df: DataFrame, column: str, prob: float, by: tuple = (), out: str | None = None) -> DataFrame:
    """Clip a column from above at its quantile, of the whole table or of each group."""
    if by:
        caps = exact_quantiles(df, column, [prob], by).select(*by, F.col("value").alias("_cap"))
        capped = lookup_join(df, caps, list(by))
    else:
        capped = with_scalars(df, quantile_row(df, column, {"_cap": prob}))
    return capped.withColumn(out or column, bounded(F.col(column), high=F.col("_cap"))).drop("_cap")


def clip_between(df: DataFrame, column: str, low: float, high: float, out: str | None = None) -> DataFrame:
    """Clip a column at a lower and an upper quantile."""
    capped = with_scalars(df, quantile_row(df, column, {"_floor": low, "_cap": high}))
    clipped = bounded(F.col(column), F.col("_floor"), F.col("_cap"))
    return capped.withColumn(out or column, clipped).drop("_floor", "_cap")
