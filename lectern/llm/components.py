"""Connected components of an edge table by alternating stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, written

#: Rounds before giving up; stars need a logarithmic number.
MAX_ROUNDS = 60


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is itself the smaller one, never both."""
    roles = edges.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    mixed = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
    return mixed.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (columns ``a``, ``b``) but the roots, the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest one, then the
    smaller ones, until only stars are left; minima are aggregated before the
    shuffle, so a node may have any number of edges. Nulls are no nodes; loops and
    repeated edges change nothing.
    """
    e = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    for _ in range(MAX_ROUNDS):
        if _all_stars(e):
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # Written, so that the join below shuffles both its sides: only such joins are split where a node has very many edges.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # An edge (u, v) with u < v becomes (v, smallest of u's): u is the edge's lower end.
        large = written(e.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")))
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(first.select("hi", F.col("m").alias("lo")))
        before, e = e, written(small.filter("hi > lo").distinct())
        # The new edges are a table of their own: those of the round before are not needed to make them again.
        discard(before, least, large)
    raise RuntimeError("components did not settle")
