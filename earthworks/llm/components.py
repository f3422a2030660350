"""Connected components of a graph given by its links, by alternating star steps.

A large step hangs every larger neighbour of a node on the smallest node it sees, a small step does so with the smaller
ones; both keep components whole, and after a few rounds each component is a star around its smallest node. A step is an
aggregate and an equi-join, so a node with very many links is split by skew handling and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.llm.store import kept


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hung(near: DataFrame) -> DataFrame:
    """Neighbours of each node with the smallest of them and itself."""
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.join(least, "a")


def _large(links: DataFrame) -> DataFrame:
    return _hung(_both(links)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that is not a root.

    ``links`` has two long columns ``a`` and ``b``. Loops and repeated links do no harm; without links the result is empty.
    """
    current = kept(links.where("a != b").select("a", "b").distinct(), "links")
    state = None
    while state != (state := _state(current)):
        current = kept(_small(_large(current)), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
