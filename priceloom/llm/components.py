"""Connected components of a link table, by alternating star contractions."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.session import checkpointed


def _state(links: DataFrame):
    # Added as decimals, which cannot overflow a long.
    mark = F.xxhash64("low", "high").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mark)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: the smallest node that it reaches.

    Each round hangs the neighbours of a node on its smallest neighbour, first the larger ones, then
    the smaller ones, so the number of links never grows and rounds are logarithmic in practice.
    A node with very many links is a hot key of an equi-join, which adaptive execution splits.
    Repeated links and links to oneself change nothing; a link with a null end is no link.
    """
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
                         .distinct())
    before = None
    while (state := _state(links)) != before:
        before = state
        both = links.union(links.select("high", "low")).toDF("node", "near")
        smallest = both.groupBy("node").agg(F.min("near").alias("least"))
        wide = (both.join(smallest, "node").where("near > node")
                .select(F.least("node", "least").alias("low"), F.col("near").alias("high")).distinct())
        wide = checkpointed(wide)
        smallest = wide.groupBy("high").agg(F.min("low").alias("least"))
        hung = (wide.join(smallest, "high")
                .select(F.col("least").alias("low"), F.explode(F.array("high", "low")).alias("high"))
                .where("low < high").distinct())
        links = checkpointed(hung)
    stars = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stars.union(links.select("low", "low").distinct().toDF("node", "root"))


def contract(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest index that each of ``size`` nodes reaches over the given links, in memory."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        while (jumped := after[after]).tolist() != after.tolist():
            after = jumped
        if (after == label).all():
            return label
        label = after
