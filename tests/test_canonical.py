import json
import random

from pyspark.sql import functions as F

from quernstone.functions import canonical
from quernstone.operators import aggregates, paging


def nested(rnd, depth=3):
    kind = rnd.randrange(6 if depth else 4)
    if kind == 4:
        return [nested(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    if kind == 5:
        return {rnd.choice("abcdefgh") + rnd.choice(["", "é", " "]): nested(rnd, depth - 1) for _ in range(rnd.randrange(5))}
    return [None, rnd.randrange(-5, 10**9), rnd.choice(["", "x y", "ß\"q"]), rnd.random() < 0.5][kind]


def shuffled(value, rnd):
    if isinstance(value, dict):
        items = list(value.items())
        rnd.shuffle(items)
        return {k: shuffled(v, rnd) for k, v in items}
    return [shuffled(v, rnd) for v in value] if isinstance(value, list) else value


def test_free_json(spark):
    rnd = random.Random(1)
    values = [nested(rnd) for _ in range(200)]
    rows = [(i, json.dumps(v), json.dumps(shuffled(v, rnd), indent=1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", canonical.canonical_text(F.col("a")).alias("a"), canonical.canonical_text(F.col("b")).alias("b"))
    for r in df.collect():
        assert r.a == r.b and json.loads(r.a) == values[r.i]
    bad = spark.createDataFrame([("{",), (None,), ("",)], "a string").select(canonical.canonical_text(F.col("a")).alias("c"))
    assert [r.c for r in bad.collect()][:2] == [None, None]


def test_schemas_at_every_depth(spark):
    a = spark.sql("select 7 as id, named_struct('b', 1, 'a', array(named_struct('y', 1, 'x', null))) as r, map('k', 1, 'b', 2) as m, array(named_struct('name', 'n', 'fetched_at', 5)) as sources")
    b = spark.sql("select array(named_struct('fetched_at', 9, 'name', 'n')) as sources, map('b', 2, 'k', 1) as m, named_struct('a', array(named_struct('x', null, 'y', 1)), 'b', 1) as r, 8 as id")
    one, other = (df.select(canonical.record_id(df).alias("i"), canonical.canonical_json(F.struct(*df.columns), df.schema, canonical.VOLATILE).alias("j")).first() for df in (a, b))
    assert one == other and one.j == '{"m":{"b":2,"k":1},"r":{"a":[{"x":null,"y":1}],"b":1},"sources":[{"name":"n"}]}'
    changed = a.withColumn("m", F.create_map(F.lit("k"), F.lit(3)))
    assert changed.select(canonical.record_id(changed)).first()[0] != one.i
    empty = spark.sql("select cast(null as struct<a:int>) as r, named_struct('id', 1) as s")
    assert empty.select(canonical.canonical_json(F.struct("r", "s"), empty.schema, ("s.id",))).first()[0] == '{"r":null,"s":{}}'


def test_simple_hash(spark):
    def slow(text):
        h = 0
        for u in memoryview(text.encode("utf-16-le")).cast("H"):
            h = (h * 31 + u) & 0xFFFFFFFF
        h = (1 << 32) - h if h >= 1 << 31 else h
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out or "0"

    texts = ["", "a", "wfp-price-2024", "حوارة", "\U0001f600 x", "z" * 500]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(canonical.simple_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [*map(slow, texts), None]


def test_merged_top(spark):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(3, 9).withColumnRenamed("id", "x")
    top = paging.merged_top([a, b], [F.desc("x")], 4).collect()
    assert [r.x for r in top] == [8, 7, 6, 5] and all(r.truncated for r in top)
    assert {r.truncated for r in paging.merged_top([a, b], [F.desc("x")], 11).collect()} == {False}
    assert paging.merged_top([a.limit(0)], [F.desc("x")], 3).collect() == []


def test_clusters_of_two_grains(spark):
    rows = spark.createDataFrame([(1, "p", "A", "2024-01-01", "x", None, 2), (2, None, "A", "2024-01-07", "y", "r", None), (3, "p", None, "2024-01-08", "x", "q", 1), (4, "p", "A", None, "x", "q", 1)],
                                 "id int, place string, admin string, date string, type string, region string, killed int").withColumn("date", F.col("date").cast("date"))
    members = aggregates.cluster_members(rows, "place", "admin", "date")
    got = {r.cluster_key: (r.place_kind, r.record_count, r.categories, r.region, r.killed) for r in aggregates.event_clusters(members, "id", "type", ["killed"], ["region"]).collect()}
    assert got == {
        "p|2024-W01": ("gazetteer", 1, ["x"], None, 2), "p|2024-W02": ("gazetteer", 1, ["x"], "q", 1), "admin2:a|2024-W01": ("admin2", 2, ["x", "y"], "r", 2),
    }
