import heapq
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import routes

SCHEMA = "edge string, src bigint, dst bigint, cost double, gate_status string, verify boolean"


def dijkstra(edges, source):
    out, queue = {}, [(0.0, source)]
    while queue:
        d, n = heapq.heappop(queue)
        if n not in out:
            out[n] = d
            for _, a, b, c, *_ in edges:
                if a == n and c is not None:
                    heapq.heappush(queue, (d + c, b))
    return out


def graph(seed, n=40, m=130):
    rnd = random.Random(seed)
    at = [(rnd.random(), rnd.random()) for _ in range(n)]
    rows = []
    for i in range(m):
        a, b = rnd.sample(range(n), 2)
        far = ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
        cost = None if rnd.random() < 0.1 else round(far * (1 + rnd.random()), 3)
        rows.append((f"e{i}", a, b, cost, rnd.choice(["open", "open", "slow"]), rnd.random() < 0.1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_costs_equal_dijkstra_with_fewer_places(spark, seed):
    rows = graph(seed)
    want = dijkstra(rows, 0)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = routes.open_edges(df)
    marks = routes.landmark_distances(edges, [5, 17, 33])
    whole = routes.cheapest(edges, 0, 1)
    assert {r.node: round(r.cost, 9) for r in whole.collect()} == {n: round(c, 9) for n, c in want.items()}
    targets = [n for n in sorted(want) if n][:2]
    came = 0
    for t in targets:
        found = routes.cheapest(edges, 0, t, marks)
        cost = {r.node: r.cost for r in found.collect()}
        came += len(cost)
        assert cost[t] == pytest.approx(want[t])
        taken = sorted(routes.legs(found, t, df).collect(), key=lambda r: r.leg)
        assert taken[0].src == 0 and taken[-1].dst == t and all(a.dst == b.src for a, b in zip(taken, taken[1:]))
        assert sum(r.minutes for r in taken) == pytest.approx(want[t])
        assert routes.unsafe_legs(spark.createDataFrame(taken), df).isEmpty()
    assert came < len(targets) * len(want)


def test_a_closed_gate_makes_a_detour_and_forbidden_edges_are_never_taken(spark):
    rows = [("direct", 0, 3, None, "open", False), ("a", 0, 1, 5.0, "open", False), ("b", 1, 3, 5.0, "open", False), ("c", 0, 2, 9.0, "slow", False), ("d", 2, 3, 9.0, "open", True)]
    df = spark.createDataFrame(rows, SCHEMA)

    def answer(df):
        found = routes.cheapest(routes.open_edges(df), 0, 3)
        taken = routes.legs(found, 3, df)
        return sorted(r.edge for r in taken.collect()), routes.verdict(found, 0, 3, taken).first()

    edges, said = answer(df)
    assert edges == ["a", "b"] and (said.verdict, said.minutes, said.legs, said.worst_gate) == ("clear", 10.0, 2, "open")
    edges, said = answer(df.withColumn("cost", F.when(F.col("edge") != "b", F.col("cost"))))
    assert edges == ["c", "d"] and (said.verdict, said.needs_verification, said.worst_gate) == ("caution", True, "slow")
    edges, said = answer(df.withColumn("cost", F.when(F.col("dst") != 3, F.col("cost"))))
    assert edges == [] and (said.found, said.verdict, said.minutes) == (False, "hold", None)
    bad = spark.createDataFrame([("direct", 1)], "edge string, leg int")
    assert [r.edge for r in routes.unsafe_legs(bad, df).collect()] == ["direct"]
    with pytest.raises(ValueError):
        routes.open_edges(df.withColumn("cost", F.lit(-1.0)))


def test_a_long_way_by_doubling(spark):
    n = 45
    places = spark.range(n).select(F.col("id").alias("node"), F.col("id").cast("double").alias("cost"), F.col("id").cast("int").alias("hops"), F.when(F.col("id") > 0, F.col("id") - 1).alias("via"))
    for target in (0, 1, 2, 31, 32, n - 1):
        assert sorted(r.node for r in routes.way_to(places, target).collect()) == list(range(target + 1))
    assert routes.way_to(places, 99).collect() == []
