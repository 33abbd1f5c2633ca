import random

import pytest
from pyspark.sql import functions as F

from quernstone.scratch import scratch_path
from quernstone.sources.keyed_table import PUT, REMOVE, KeyedTable

SCHEMA = "k string, at int, op string, name string, last string, top double, n bigint, by array<struct<set: string, url: string>>"
RULES = {"name": "first", "last": "last", "top": "max", "n": "sum", "by": "union:set"}


def changes(seed, batches=12, keys=9):
    rnd = random.Random(seed)
    out = []
    for b in range(batches):
        rows = []
        for at in range(rnd.randrange(12)):
            by = None if rnd.random() < 0.2 else [(rnd.choice("xyz"), f"u{b}-{at}-{i}") for i in range(rnd.randrange(3))]
            key = None if rnd.random() < 0.05 else f"k{rnd.randrange(keys)}"
            rows.append((key, at, REMOVE if rnd.random() < 0.1 else PUT, rnd.choice([None, "a", "b"]), rnd.choice([None, "c", "d"]), rnd.choice([None, 1.0, 2.5]), rnd.randrange(4), by))
        out.append(rows)
    return out


def folded(batches):
    state = {}
    for rows in batches:
        for k, _, op, name, last, top, n, by in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
            if op == REMOVE:
                state.pop(k, None)
                continue
            s = state.setdefault(k, {"name": None, "last": None, "top": None, "n": None, "by": None})
            s["name"] = s["name"] if s["name"] is not None else name
            s["last"] = last if last is not None else s["last"]
            s["top"] = top if s["top"] is None else s["top"] if top is None else max(top, s["top"])
            s["n"] = (s["n"] or 0) + n
            for e in by or []:
                if e[0] not in {x[0] for x in s["by"] or []}:
                    s["by"] = [*(s["by"] or []), e]
    return {k: tuple(s.values()) for k, s in state.items()}


def rows_of(df):
    return {r.k: (r.name, r.last, r.top, r.n, None if r.by is None else [tuple(e) for e in r.by]) for r in df.collect()}


def applied(spark, table, batches, numbers=None):
    for b in range(len(batches)) if numbers is None else numbers:
        table.apply(b, spark.createDataFrame(batches[b], SCHEMA), "at", "op")


@pytest.fixture
def table(spark):
    return KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], RULES)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_replay_in_memory(spark, table, seed):
    batches = changes(seed)
    applied(spark, table, batches)
    assert rows_of(table.read()) == folded(batches)
    for upto in (0, 5):
        assert rows_of(table.read(upto)) == folded(batches[: upto + 1])


def test_a_batch_again_changes_nothing(spark, table):
    batches = changes(3)
    applied(spark, table, batches)
    assert not table.apply(4, spark.createDataFrame(batches[7], SCHEMA), "at", "op")
    assert rows_of(table.read()) == folded(batches)


def test_compaction(spark, table):
    batches = changes(4)
    applied(spark, table, batches, range(5))
    assert table.compact() == 4 and table.compact() == 4
    applied(spark, table, batches, range(12))  # those below the base are left out
    assert rows_of(table.read()) == folded(batches)
    assert rows_of(table.read(2)) == folded(batches[:3])
    assert table.compact() == 11
    table.vacuum()
    assert table._numbers("delta") == [] and table._numbers("base") == [11]
    assert rows_of(table.read()) == folded(batches)
    table.apply(12, spark.createDataFrame([("k0", 1, REMOVE, None, None, None, None, None)], SCHEMA), "at", "op")
    assert rows_of(table.read()) == {k: v for k, v in folded(batches).items() if k != "k0"}


def test_a_batch_that_was_cut_off_does_not_count(spark, table):
    batches = changes(5, 3)
    applied(spark, table, batches, [0, 1])
    # what a lost writer leaves: files without the mark of the end
    spark.createDataFrame(batches[2], SCHEMA).limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/delta/{2:012d}")
    assert rows_of(table.read()) == folded(batches[:2])
    assert table.apply(2, spark.createDataFrame(batches[2], SCHEMA), "at", "op")
    assert rows_of(table.read()) == folded(batches)


def test_feed(spark, table):
    batches = changes(6)
    applied(spark, table, batches)
    before, after = folded(batches[:5]), folded(batches)
    got = {r.k: r.change for r in table.feed(4).collect()}
    want = {k: "added" for k in after.keys() - before.keys()} | {k: "removed" for k in before.keys() - after.keys()}
    want |= {k: "changed" for k in after.keys() & before.keys() if after[k] != before[k]}
    assert got == want
    assert {r.k for r in table.feed(None).collect()} == set(after)


def test_awkward(spark, table):
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        KeyedTable(spark, table.path, ["k"], {"name": "newest"})
    table.apply(0, spark.createDataFrame([], SCHEMA), "at", "op")
    assert table.read().collect() == []
    only = KeyedTable(spark, scratch_path(spark, "keyed"), ["a", "b"], {"s": "union"})
    rows = spark.createDataFrame([(1, 2, ["x", None, "x", "y"]), (1, 2, ["y", "z"]), (1, 3, None), (None, 3, ["q"])], "a int, b int, s array<string>")
    only.apply(0, rows.withColumn("clash", F.lit(1)), F.lit(0))
    assert {(r.a, r.b): r.s for r in only.read().collect()} == {(1, 2): ["x", "y", "z"], (1, 3): None}
