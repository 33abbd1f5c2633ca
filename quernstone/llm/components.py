"""Connected components of a graph of pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b): the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands the smallest
    of its neighbours to its larger ones, then to its smaller ones.  Each step
    is a minimum, combined before the shuffle, and a join that adaptive
    execution splits where a node has very many neighbours; the rounds grow with
    the logarithm of the longest path.  Each round is written to the shared
    folder, so a lost executor costs one round.
    """
    current = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = (
            linked.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = staged(small, "edges")
        if (after := _state(current)) == state:
            break
        state = after
    return current.select("a", F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct()
    )
