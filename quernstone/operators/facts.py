"""Fact log with decaying confidence, consensus of reports, incidents, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FACT_HALF_LIVES, FACT_SOURCES, STATUS_PENALTIES, STATUS_SEVERITY
from ..functions.scores import half_life
from ..scratch import shared_folder

STALE = 0.40


def _by_source(source: Column, index: int) -> Column:
    value = F.lit((0.30, 0.0)[index])
    for name, both in FACT_SOURCES.items():
        value = F.when(source == name, float(both[index])).otherwise(value)
    return value


def fact_half_life(kind: Column) -> Column:
    """Days by kind of fact, 120 for others."""
    pairs = F.create_map(*(F.lit(x) for kv in FACT_HALF_LIVES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, kind), F.lit(120.0))


def effective_confidence(facts: DataFrame, as_of: Column, half_days: Column | float = 120.0) -> DataFrame:
    """``facts`` with rank and with base confidence halved every ``half_days`` since last_verified."""
    age = F.datediff(as_of, F.col("last_verified"))
    half = half_days if isinstance(half_days, Column) else F.lit(half_days)
    return facts.withColumns(
        {"rank": _by_source(F.col("source"), 1).cast("int"), "confidence": F.round(half_life(_by_source(F.col("source"), 0), age, half), 4)}
    )


def current_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The fact of each key with the highest (rank, confidence), then the latest, then the largest id."""
    rest = [c for c in facts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("rank", "confidence", "last_verified", "fact_id")).alias("__f")
    return facts.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__f.{c}").alias(c) for c in rest))


def consensus(reports: DataFrame, keys: list[str], as_of: Column, hours: float = 6.0, half_minutes: float = 30.0, admin: float = 5.0) -> DataFrame:
    """Status of each key from weighted reports of the last hours.

    Weights are 5 for admins and 1 for others, halved every 30 minutes.  If the
    winner has no admin behind it and another status has at least 4 reports and
    3 times as many, that one wins.  Ties go to the smaller status.
    """
    age = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 60.0
    weight = F.when(F.col("source_type") == "admin", admin).otherwise(1.0) * F.pow(F.lit(0.5), F.col("__age") / half_minutes)
    recent = reports.withColumn("__age", age).filter(F.col("__age").between(0, hours * 60)).withColumn("__w", weight)
    votes = recent.groupBy(*keys, "status").agg(
        F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"), F.max((F.col("source_type") == "admin").cast("int")).alias("admins")
    )
    ranked = votes.withColumn("w", F.round("w", 9))
    rows = F.collect_list(F.struct("status", "w", "n", "admins"))  # one row for each status
    per_key = ranked.groupBy(*keys).agg(
        F.sum("w").alias("total"),
        F.min(F.struct((-F.col("w")).alias("w"), "status", "n", "admins")).alias("top"),
        rows.alias("all"),
    )
    crowd = F.array_sort(
        F.filter("all", lambda x: (x["status"] != F.col("top.status")) & (x["n"] >= 4) & (x["n"] >= 3 * F.col("top.n"))),
        lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["status"] < b["status"], -1).otherwise(1),
    )
    switched = (F.col("top.admins") == 0) & (F.size("crowd") > 0)
    chosen = F.when(F.col("switched"), F.element_at("crowd", 1)["status"]).otherwise(F.col("top.status"))
    won = F.when(F.col("switched"), F.element_at("crowd", 1)["w"]).otherwise(-F.col("top.w"))
    admins = F.when(F.col("switched"), F.element_at("crowd", 1)["admins"]).otherwise(F.col("top.admins"))
    ratio = F.round(F.coalesce(F.try_divide(won, F.col("total")), F.lit(0.0)), 4)
    return (
        per_key.withColumn("crowd", F.when(F.size(crowd) > 0, crowd).otherwise(F.array().cast(per_key.schema["all"].dataType)))
        .withColumn("switched", switched)
        .select(
            *keys, chosen.alias("status"), ratio.alias("ratio"),
            F.when((ratio >= 0.75) & (admins == 1), "high").when(ratio >= 0.5, "medium").otherwise("low").alias("confidence"),
        )
    )


def sessions(alerts: DataFrame, keys: list[str], time: str, gap_seconds: int = 7200) -> DataFrame:
    """``alerts`` with the number of their incident: a gap of more than ``gap_seconds`` starts a new one.

    NULL keys are a group of their own.
    """
    order = Window.partitionBy(*keys).orderBy(time, "id")
    before = F.lag(F.unix_seconds(F.col(time).cast("timestamp"))).over(order)
    starts = F.when(before.isNull() | (F.unix_seconds(F.col(time).cast("timestamp")) - before > gap_seconds), 1).otherwise(0)
    return alerts.withColumn("__start", starts).withColumn("incident", F.sum("__start").over(order).cast("bigint")).drop("__start")


def corroboration_boost(sources: Column, each: float = 0.10, most: float = 0.30) -> Column:
    return F.least(F.lit(most), sources * each)


def edge_cost(edges: DataFrame, status: str, confidence: str, residents: str, penalties: dict[str, float] | None = None) -> DataFrame:
    """``edges`` with ``cost``: base minutes and penalties; NULL if closed or forbidden."""
    penalty = F.lit(0.0)
    for name, value in (penalties or STATUS_PENALTIES).items():
        penalty = F.when(F.col(status) == name, value).otherwise(penalty)
    cost = F.col("base_minutes") + penalty + F.when(F.col(residents), 30.0).otherwise(0.0) + F.when(F.col(confidence) < STALE, 15.0).otherwise(0.0)
    return edges.withColumn("cost", F.when((F.col(status) == "closed") | F.col("forbidden"), F.lit(None)).otherwise(cost))


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(node, cost, hops, via) of the cheapest way from ``source``; edges (src, dst, cost), NULL costs closed.

    ``via`` is the node before, NULL at the source.  Relaxation round by round
    over the whole graph: a join on the frontier and a minimum per node.  It ends
    when no node gets cheaper, however long the ways are; costs below 0 are
    refused, as a cycle of them would have no end.  Each round is checkpointed
    in the folder that the session names, which keeps plans short and survives
    lost executors.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    open_ = edges.filter("cost is not null").groupBy("src", "dst").agg(F.min(F.col("cost").cast("double")).alias("c")).checkpoint()
    if not open_.filter("c < 0").isEmpty():
        raise ValueError("costs must not be negative")
    kind = "node bigint, cost double, hops int, via bigint, fresh boolean"
    best = spark.createDataFrame([(source, 0.0, 0, None, True)], kind).coalesce(1)
    while not best.filter("fresh").isEmpty():
        reached = best.filter("fresh").join(open_, F.col("node") == F.col("src")).select(
            F.col("dst").cast("bigint").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"),
            F.col("src").cast("bigint").alias("via"), F.lit(True).alias("fresh"),
        )
        # on equal costs the known way stays, as false comes before true
        least = F.min(F.struct("cost", "fresh", "hops", "via")).alias("m")
        known = best.withColumn("fresh", F.lit(False))
        best = known.unionByName(reached).groupBy("node").agg(least).select("node", "m.cost", "m.hops", "m.via", "m.fresh").checkpoint()
    return best.select("node", "cost", "hops", "via")


def path_to(paths: DataFrame, target: int) -> list[int]:
    """The nodes of the way to ``target`` in order, from ``shortest_paths``; empty if there is none.

    A way is as long as it has nodes, which is what comes to the driver.
    """
    way: list[int] = []
    node: int | None = target
    while node is not None:
        row = paths.filter(F.col("node") == node).select("via").first()
        if row is None:
            return []
        way.append(node)
        node = row.via
    return way[::-1]


def severity_of_gates(gates: DataFrame, live: DataFrame, edge: str, gate: str) -> DataFrame:
    """The worst live status over each edge's gates; a gate without one is partial, an odd one unknown."""
    joined = gates.join(live, gate, "left").withColumn("status", F.coalesce("status", F.lit("partial")))
    order = F.array(*map(F.lit, STATUS_SEVERITY))
    known = F.when(F.array_contains(order, F.col("status")), F.col("status")).otherwise("unknown")
    rank = F.array_position(order, known) - 1
    worst = joined.withColumn("rank", rank).groupBy(edge).agg(F.max("rank").cast("int").alias("worst"))
    return worst.withColumn("status", F.element_at(order, F.col("worst") + 1))


def safety_violations(path_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a route that are forbidden or unknown: must be empty."""
    allowed = edges.filter("not forbidden").select("src", "dst")
    return path_edges.join(allowed, ["src", "dst"], "left_anti")
