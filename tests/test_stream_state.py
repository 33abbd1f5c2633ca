"""What streams write and hold grows with their rows, not with their pairs or a call for each key."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import identity
from quernstone.scratch import scratch_path
from quernstone.sources.keyed_table import KeyedTable
from quernstone.streaming import jobs, stateful

from .test_streams import START, stream_of


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "stream-state")


def test_review_items_share_keys_of_the_state(spark, folder):
    rows = [[(0, i, 0.5, "active") for i in range(3000)], [(30 * 3600, None, None, None)]]
    writer = stateful.review_resolutions(stream_of(spark, folder, rows, "ts id confidence status")).writeStream.trigger(availableNow=True)
    query = jobs.started(writer.option("checkpointLocation", f"{folder}/c").format("parquet").option("path", f"{folder}/out"), spark)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(f"{folder}/out").count() == 3000 and 0 < max(held) <= 4 * stateful.SLOTS


def alerts(seed, n=400):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(4 * 3600), i, rnd.choice("xy"), rnd.choice("ab"), rnd.choice(["s1", "s2", "s3", None])) for i in range(n)]
    late = sorted(rows, key=lambda r: r[0] + (2400 if rnd.random() < 0.1 else 0))
    return rows, [late[i : i + 80] for i in range(0, n, 80)] + [[(40 * 3600, None, None, None, None)]]


def test_corroboration_equals_all_pairs(spark, folder, monkeypatch):
    monkeypatch.setattr(stateful, "PAIRS", 50)
    rows, cuts = alerts(1)
    stream = stream_of(spark, folder, cuts, "ts id type area source")
    got = jobs.run_available(jobs.corroborated(stream, 1200), folder).collect()
    want = [(i, j, t) for t, i, k, a, s in rows for u, j, l, b, o in rows if k == l and a == b and s and o and s != o and 0 <= t - u <= 1200]
    assert sorted((r.id, r.other, int(r.ts.timestamp()) - START) for r in got) == sorted(want)
    # a key's rows are one value of the state, and no join holds both sides
    assert "StreamingSymmetricHashJoin" not in jobs.corroborated(stream, 1200)._jdf.queryExecution().toString()


@pytest.mark.parametrize("tile, sources", [(1, 2), (3, 3), (16, 12), (2048, 3)])
def test_tiles_hold_all_pairs(spark, folder, tile, sources):
    """Tiles that cut a window many times, and sources that are large or small in their type and area."""
    rnd = random.Random(tile)
    rows = [(rnd.randrange(3 * 3600), i, rnd.choice("xy"), rnd.choice("ab"), f"s{min(rnd.randrange(sources), rnd.randrange(sources))}") for i in range(300)]
    late = sorted(rows, key=lambda r: r[0] + (2400 if rnd.random() < 0.1 else 0))
    stream = stream_of(spark, folder, [late[i : i + 100] for i in range(0, 300, 100)], "ts id type area source")
    tiles = jobs.run_available(stateful.corroboration_tiles(stream, 1200, tile=tile), folder)
    want = [(i, j, t) for t, i, k, a, s in rows for u, j, l, b, o in rows if k == l and a == b and s != o and 0 <= t - u <= 1200]
    assert sorted((r.id, r.other, int(r.ts.timestamp()) - START) for r in stateful.pairs_of(tiles).collect()) == sorted(want)
    assert tiles.filter(F.greatest(F.size("ids"), F.size("others")) > tile).count() == 0


def test_corroboration_stream_writes_no_pairs(spark, folder, monkeypatch):
    """2000 alerts of one type and area in an hour have a million pairs: before, the stream wrote and read each."""
    from quernstone.plans import streams

    monkeypatch.setattr(streams, "_folder", lambda s: f"{folder}/streams")
    n = 2000
    at = F.timestamp_micros(F.lit(START * 1_000_000) + F.col("event_id") * 1_800_000)
    rows = spark.range(n).withColumnRenamed("id", "event_id").withColumns({
        "ts": at.cast("timestamp_ntz"), "user_id": 1 + F.col("event_id") % 2 * 15, "event_type": F.lit("view"), "value": F.lit(1.0), "props": F.lit('{"k": 1}'),
    })
    rows.write.parquet(f"{folder}/events.parquet")
    got = streams.corroboration(spark, folder)
    assert got.agg(F.count("*"), F.countDistinct("id", "other"), F.min(F.col("id") - F.col("other"))).first()[:] == (n * n // 4, n * n // 4, 1)
    outs = [f.getPath().toString() for f in _files(spark, f"{folder}/streams") if "/out/" in f.getPath().toString() and f.getPath().getName().endswith(".parquet")]
    assert spark.read.parquet(*outs).count() < n


def _files(spark, path):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while found.hasNext():
        yield found.next()


def test_boost_batches_have_a_row_for_an_alert(spark, folder):
    rows, cuts = alerts(2)
    boosts = KeyedTable(spark, f"{folder}/boosts", ["id"], {"sources": "union"})
    jobs.raise_both(stream_of(spark, folder, cuts, "ts id type area source"), boosts, folder, 1200)
    want = {}
    for t, i, k, a, s in rows:
        met = {o for u, _, l, b, o in rows if k == l and a == b and s and o and s != o and abs(t - u) <= 1200}
        if met:
            want[i] = met
    assert {r.id: set(r.sources) for r in boosts.read().collect()} == want
    per_alert = boosts.changes().groupBy("__batch", "id").count()
    assert per_alert.filter("count > 1").count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Blocks of a few messages, many at one time: the same rows as from all pairs of the newest."""
    monkeypatch.setattr(identity, "BLOCK", 7)
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(40) * 60, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randrange(1, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, s bigint, text string").withColumn("ts", F.timestamp_seconds("s"))
    got = identity.near_duplicates(df, "id", "text", "ts", 600, most=5)
    want = []
    for i, s, text in rows:
        for _, j, other in sorted(((u, j, x) for j, u, x in rows if (u, j) < (s, i)), reverse=True)[:5]:
            a, b = set(text.split()), set(other.split())
            u = dict((j, u) for j, u, _ in rows)[j]
            if s - u <= 600 and min(len(text), len(other)) >= 15 and len(a & b) / len(a | b) > 0.6:
                want.append((i, j, round(len(a & b) / len(a | b), 4)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # places and words, no pairs


def test_votes_of_many_reports_at_once():
    """Sums over the window give what counting each report's window gives; before, each report was a step in Python."""
    import pandas as pd

    rnd = random.Random(6)
    minute = 60_000_000
    t = sorted(rnd.randrange(3000) * minute for _ in range(400))
    rows = [(u, i, rnd.choice(["open", "open", "closed", "slow"]), rnd.random() < 0.1) for i, u in enumerate(t)]
    processor = stateful.ConsensusProcessor(30.0, 6.0, 5.0, 36.0)
    got = processor._decided(pd.DataFrame(rows, columns=["t", "id", "status", "admin"]), 50)
    for k in range(50, len(rows)):
        window = [r for r in rows[: k + 1] if rows[k][0] - r[0] <= 360 * minute]
        w = {s: round(sum((5.0 if a else 1.0) * 0.5 ** ((rows[k][0] - u) / 30 / minute) for u, _, x, a in window if x == s), 9) for s in {r[2] for r in window}}
        n = {s: sum(r[2] == s for r in window) for s in w}
        top = min(w, key=lambda s: (-w[s], s))
        if not any(r[3] for r in window if r[2] == top):
            top = min((s for s in w if s != top and n[s] >= 4 and n[s] >= 3 * n[top]), key=lambda s: (-n[s], s), default=top)
        assert got["status"][k - 50] == top and abs(got["ratio"][k - 50] - w[top] / sum(w.values())) < 6e-5


def test_a_micro_batch_has_a_file_for_each_core(spark, folder):
    """Before, a tenth of the rows was one file, and its texts were read in one task."""
    from quernstone.plans import streams

    rows = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    seen = []
    stream = streams._as_stream(rows, folder, "rows")
    query = stream.writeStream.trigger(availableNow=True).foreachBatch(lambda batch, n: seen.append((batch.count(), len(batch.inputFiles())))).start()
    query.awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert sum(n for n, _ in seen) == 4000 and len(seen) == streams.BATCHES
    assert len(list(spark.read.parquet(f"{folder}/rows-*").inputFiles())) == streams.BATCHES * cores
