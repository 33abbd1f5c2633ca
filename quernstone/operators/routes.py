"""Routes through a graph of roads with gates: goal-directed search, legs, and a verdict.

Distances from and to a few landmarks, computed once, bound from below what is left to
the goal (by the triangle inequality) and from above what the whole way costs.  A
relaxation round then goes on only from places that can still lie on a cheapest way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ROUTE_SEVERITY
from ..scratch import written

#: Differences of costs below this are rounding.
NEAR = 1e-9
_STATE = "mark bigint, node bigint, cost double, hops int, via bigint, fresh boolean"


def open_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, c): the cheapest open edge of each pair; NULL costs are closed, those below 0 refused."""
    found = edges.filter("cost is not null").groupBy(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    found = written(found.agg(F.min(F.col("cost").cast("double")).alias("c")), "route-edges")
    if not found.filter("c < 0").isEmpty():
        raise ValueError("costs must not be negative")
    return found


def _relaxed(edges: DataFrame, sources: list[int], keep=None) -> DataFrame:
    """(mark, node, cost, hops, via) of the cheapest way from each of ``sources``, all of them at once.

    ``keep`` is a condition on node and cost; a place that fails it goes no further.
    """
    spark = edges.sparkSession
    best = spark.createDataFrame([(s, s, 0.0, 0, None, True) for s in sources], _STATE)
    while not best.filter("fresh").isEmpty():
        front = best.filter("fresh")
        reached = front.join(edges, F.col("node") == F.col("src")).select(
            "mark", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"),
            F.col("src").alias("via"), F.lit(True).alias("fresh"),
        )
        if keep is not None:
            reached = keep(reached)
        # on equal costs what is known stays, as false comes before true
        least = F.min(F.struct("cost", "fresh", "hops", "via")).alias("m")
        every = best.withColumn("fresh", F.lit(False)).unionByName(reached)
        best = written(every.groupBy("mark", "node").agg(least).select("mark", "node", "m.cost", "m.hops", "m.via", "m.fresh"), "route-round")
    return best.drop("fresh")


def landmark_distances(edges: DataFrame, landmarks: list[int]) -> DataFrame:
    """(mark, node, there, back): costs from each landmark to a node, and from the node to it; NULL if there is no way.

    ``edges`` are those of ``open_edges``.  The table serves every route until the costs change.
    """
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c")
    there = _relaxed(edges, landmarks).select("mark", "node", F.col("cost").alias("there"))
    back = _relaxed(turned, landmarks).select("mark", "node", F.col("cost").alias("back"))
    return written(there.join(back, ["mark", "node"], "full"), "route-landmarks")


def cheapest(edges: DataFrame, source: int, target: int, marks: DataFrame | None = None) -> DataFrame:
    """(node, cost, hops, via) of the places that the search from ``source`` to ``target`` came to.

    That of ``target``, if any, has the cost of the cheapest way.  ``marks`` is the
    table of ``landmark_distances``; without it nothing is left out.
    """
    if marks is None:
        return _relaxed(edges, [source]).drop("mark")
    ends = {
        r.mark: r
        for r in marks.filter(F.col("node").isin(source, target)).groupBy("mark").agg(
            *(F.max(F.when(F.col("node") == n, F.col(c))).alias(f"{a}_{c}") for n, a in ((source, "s"), (target, "t")) for c in ("there", "back"))
        ).collect()  # one row a landmark
    }
    # a way by a landmark bounds the cost from above
    most = min((r.s_back + r.t_there for r in ends.values() if r.s_back is not None and r.t_there is not None), default=float("inf"))
    left = F.lit(0.0)
    for mark, r in ends.items():
        own = F.col("mark") == mark
        # what is left is at least the difference of distances to a landmark, on either side
        if r.t_there is not None:
            left = F.when(own, F.greatest(left, F.coalesce(F.lit(r.t_there) - F.col("there"), F.lit(0.0)))).otherwise(left)
        if r.t_back is not None:
            left = F.when(own, F.greatest(left, F.coalesce(F.col("back") - F.lit(r.t_back), F.lit(0.0)))).otherwise(left)
    bounds = written(marks.groupBy("node").agg(F.max(left).alias("left")).filter("left > 0"), "route-bounds")

    def keep(reached: DataFrame) -> DataFrame:
        near = reached.join(bounds, "node", "left").withColumn("left", F.coalesce("left", F.lit(0.0)))
        return near.filter(F.col("cost") + F.col("left") <= most * (1 + NEAR) + NEAR).drop("left")

    return _relaxed(edges, [source], keep).drop("mark")


def way_to(places: DataFrame, target: int) -> DataFrame:
    """(node, via, hops, cost) of the places on the way to ``target``, from ``cheapest``; none if there is no way.

    Predecessors are followed by doubling: each round jumps twice as far, so a way
    of n places takes about log2(n) joins.
    """
    end = places.filter(F.col("node") == target).select("hops").first()
    jumps = places.select("node", "via")
    way = places.filter(F.col("node") == target).select("node")
    for _ in range((end.hops if end else 0).bit_length()):
        further = way.join(jumps, "node").filter("via is not null").select(F.col("via").alias("node"))
        way = written(way.unionByName(further).distinct(), "route-way")
        beyond = jumps.select(F.col("node").alias("via"), F.col("via").alias("beyond"))
        jumps = written(jumps.join(beyond, "via").select("node", F.col("beyond").alias("via")).filter("via is not null"), "route-jumps")
    return places.join(way, "node").select("node", "via", "hops", "cost")


def legs(places: DataFrame, target: int, edges: DataFrame) -> DataFrame:
    """(leg, src, dst, edge, minutes, gate_status, verify) of the way to ``target`` in order.

    ``edges``: edge, src, dst, cost, gate_status, verify (low confidence or for
    residents only).  Of parallel edges the cheapest was taken, of equal ones the
    first by ``edge``.
    """
    way = way_to(places, target).filter("via is not null")
    usable = edges.filter("cost is not null")
    rest = F.struct("cost", "edge", "gate_status", "verify")
    best = usable.groupBy(F.col("src").alias("via"), F.col("dst").alias("node")).agg(F.min(rest).alias("e"))
    return way.join(best, ["via", "node"]).select(
        F.col("hops").alias("leg"), F.col("via").alias("src"), F.col("node").alias("dst"), "e.edge", F.col("e.cost").alias("minutes"), "e.gate_status", "e.verify"
    )


def verdict(places: DataFrame, source: int, target: int, taken: DataFrame) -> DataFrame:
    """One row: found, verdict, needs_verification, worst_gate, minutes, legs.

    ``hold`` without a way, ``clear`` if all gates are open and nothing needs to
    be verified, else ``caution``.  Gate statuses beyond the known ones do not count.
    """
    order = F.array(*map(F.lit, ROUTE_SEVERITY))
    rank = F.coalesce(F.array_position(order, F.col("gate_status")), F.lit(0))
    whole = taken.agg(
        F.count(F.lit(1)).alias("legs"), F.coalesce(F.max(F.greatest(rank, F.lit(1))), F.lit(1)).cast("int").alias("worst"), F.coalesce(F.max("verify"), F.lit(False)).alias("needs_verification")
    )
    end = places.filter(F.col("node") == target).agg(F.min("cost").alias("minutes"))
    row = end.crossJoin(whole).withColumn("found", F.col("minutes").isNotNull())
    said = F.when(~F.col("found"), "hold").when((F.col("worst") == 1) & ~F.col("needs_verification"), "clear").otherwise("caution")
    gate = F.when(F.col("found"), F.element_at(order, F.col("worst")))
    return row.select(
        F.lit(source).cast("bigint").alias("source"), F.lit(target).cast("bigint").alias("target"), "found", said.alias("verdict"), "needs_verification",
        gate.alias("worst_gate"), F.round("minutes", 1).alias("minutes"), "legs",
    )


def unsafe_legs(taken: DataFrame, edges: DataFrame) -> DataFrame:
    """Legs over an edge that is forbidden, closed or unknown: must be empty."""
    return taken.join(edges.filter("cost is not null").select("edge"), "edge", "left_anti")
