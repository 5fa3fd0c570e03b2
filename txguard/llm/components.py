"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.session import reliable


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``a``, itself included; combined before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("__m")).select("a", F.least("a", "__m").alias("__m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("__m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = _least(down)
    moved = down.join(least, "a").where("b <> __m").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    return moved.union(least.select("a", F.col("__m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node that has an edge; the root is the least node of its component.

    ``edges`` has long columns ``a`` and ``b``; loops and repeated edges do no
    harm. Every round is kept in the shared folder. The rows of a node with many
    edges are only counted together for their least neighbour, which combines
    before the shuffle, and joined to it, which adaptive execution splits.
    """
    now = reliable(edges.where("a <> b").select("a", "b").distinct())
    state = _state(now)
    while state[0]:
        now = reliable(_small_star(reliable(_large_star(now))))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
