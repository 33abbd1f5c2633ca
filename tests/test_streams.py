"""Streams cut into many micro-batches, with late rows, restarts and state that ends."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import facts, identity
from quernstone.scratch import scratch_path
from quernstone.sources import channels
from quernstone.streaming import jobs, stateful

START = 1_700_000_000  # a second of 2023


def stream_of(spark, folder, batches, schema):
    """One file a batch, in this order; times are seconds after START."""
    path = f"{folder}/in"
    for rows in batches:
        df = spark.createDataFrame([tuple(START + v if c == "ts" else v for c, v in zip(schema.split(), r)) for r in rows], ddl(schema, "bigint"))
        df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_source(spark, path, spark.read.parquet(path).schema)


KINDS = {"id": "bigint", "other": "bigint", "rank": "int", "confidence": "double"}


def ddl(schema, time):
    return ", ".join(f"{c} {time if c == 'ts' else KINDS.get(c, 'string')}" for c in schema.split())


def seconds(rows, *columns):
    return sorted(tuple(round(v.timestamp() - START, 3) if hasattr(v, "timestamp") else v for v in (r[c] for c in columns)) for r in rows)


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "stream-test")


def test_review_timers(spark, folder):
    hour = 3600
    rows = [
        [(0, 1, 0.5, "active"), (0, 2, 0.39, "active"), (0, 3, 0.6, "active"), (10, 4, 0.4, "active"), (10, 5, 0.5, "active"), (0, 9, None, None)],
        [(30 * 60, 1, 0.45, "active"), (5, 4, 0.4, "active"), (2 * hour, 5, None, "retracted"), (hour, 6, 0.5, "active")],  # 4 comes late, but earlier
        [(25 * hour, 7, 0.5, "active")],
        [(26 * hour, 1, 0.5, "active"), (26 * hour, 6, None, "retracted")],  # known still; retracted after its timer
        [(200 * hour, None, None, None)],
        [(201 * hour, None, None, None)],
    ]
    stream = stream_of(spark, folder, rows, "ts id confidence status")
    got = jobs.run_available(stateful.review_resolutions(stream), folder).collect()
    want = [(1, 0, 24 * hour), (4, 5, 24 * hour + 5), (6, hour, 25 * hour), (7, 25 * hour, 49 * hour)]
    assert seconds(got, "id", "queued_at", "resolved_at") == want


def test_incidents_merge_through_late_rows_and_end_by_timer(spark, folder):
    hour = 3600
    rows = [
        [(0, "a", None, 1), (0, "a", "x", 0), (3 * hour, "a", "x", 2)],
        [(int(1.5 * hour) + hour, "b", "x", 0), (2 * hour, "a", "x", 1)],  # joins the two of (a, x)
        [(5 * hour, "a", "x", 0), (5 * hour + 1, "a", None, 0)],
        [(20 * hour, None, None, None)],
    ]
    stream = stream_of(spark, folder, rows, "ts type area rank")
    got = jobs.run_available(stateful.resolved_incidents(stream), folder).collect()
    want = [("a", "-", 0, 0, 1, 1, 4 * hour), ("a", "-", 5 * hour + 1, 5 * hour + 1, 1, 0, 9 * hour + 1),
            ("a", "x", 0, 5 * hour, 4, 2, 9 * hour), ("b", "x", 2.5 * hour, 2.5 * hour, 1, 0, 6.5 * hour)]
    shown = [r.asDict() | {"area": r.area or "-"} for r in got]
    assert seconds(shown, "type", "area", "first", "last", "n", "severity", "resolved_at") == want
    with pytest.raises(ValueError):
        stateful.resolved_incidents(stream, gap_seconds=7200, hours=2)


def test_restart_goes_on_where_it_ended(spark, folder):
    """Half of the files, then the rest under the same checkpoint, gives what one run gives."""
    rnd = random.Random(1)
    batches = [[(b * 5400 + rnd.randrange(3600), rnd.choice("ab"), rnd.choice("xy"), rnd.randrange(4)) for _ in range(3)] for b in range(8)]
    batches.append([(100 * 3600, None, None, None)])
    whole = jobs.run_available(stateful.resolved_incidents(stream_of(spark, f"{folder}/1", batches, "ts type area rank")), folder).collect()
    for part in (batches[:4], batches[4:]):
        stream = stream_of(spark, f"{folder}/2", part, "ts type area rank")
        twice = jobs.run_available(stateful.resolved_incidents(stream), folder, run="twice").collect()
    assert len(whole) > 4 and sorted(map(tuple, whole), key=repr) == sorted(map(tuple, twice), key=repr)


def reports(seed, n=150):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 60, 600, 1200]) if rnd.random() < 0.98 else 40 * 3600
        rows.append((t, i, rnd.choice(["k1", "k2"]), rnd.choice([None, "in"]), rnd.choice(["open"] * 5 + ["closed", "slow"]), rnd.choice(["admin"] + ["crowd"] * 9)))
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_consensus_equals_the_batch_form_at_every_report(spark, folder, seed):
    """Reports are shuffled within the delay, and every change is checked against the batch consensus of that time."""
    rows = reports(seed)
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + rnd.random() * 1800)
    cuts = [late[i : i + 13] for i in range(0, len(late), 13)]
    cuts.append([(rows[-1][0] + 10 * 3600, None, None, None, None, None)])
    stream = stream_of(spark, folder, cuts, "ts id key direction status source_type")
    got = jobs.run_available(stateful.consensus_changes(stream), folder)
    got = {(r.key, r.direction, r.id): (r.status, round(r.ratio, 3), r.confidence) for r in got.collect()}
    df = spark.createDataFrame([(START + r[0], *r[1:]) for r in rows], ddl("ts id key direction status source_type", "bigint")).withColumn("ts", F.timestamp_seconds("ts"))
    df = df.withColumn("direction", F.coalesce("direction", F.lit("")))
    # the batch form at the time of each report, over the reports up to it
    a, b = df.alias("a"), df.alias("b")
    upto = (F.col("b.ts") < F.col("a.ts")) | ((F.col("b.ts") == F.col("a.ts")) & (F.col("b.id") <= F.col("a.id")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.direction") == F.col("b.direction")) & upto)
    aged = pairs.select(F.col("a.key").alias("key"), F.col("a.direction").alias("direction"), F.col("a.id").alias("at"), "b.status", "b.source_type",
                        (F.timestamp_seconds(F.lit(START)) - (F.col("a.ts") - F.col("b.ts"))).alias("ts"))
    each = facts.consensus(aged, ["key", "direction", "at"], F.timestamp_seconds(F.lit(START)))
    every = {(r.key, r.direction, r["at"]): (r.status, round(r.ratio, 3), r.confidence) for r in each.collect()}
    want, last = {}, {}
    for t, i, key, direction, _, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        k = (key, direction or "")
        now = every[(*k, i)]
        if k not in last or last[k][0] != now[0] or t - last[k][1] > 36 * 3600:
            want[(*k, i)] = now
        last[k] = (now[0], t)
    assert got == want and len(want) > 10


def test_a_cohort_is_not_turned_by_one_recent_report(spark, folder):
    minute = 60
    rows = [[(i * minute, i, "k", None, "closed", "crowd") for i in range(5)], [(119 * minute, 9, "k", None, "open", "crowd")], [(9999 * minute, *[None] * 5)]]
    got = jobs.run_available(stateful.consensus_changes(stream_of(spark, folder, rows, "ts id key direction status source_type")), folder).collect()
    assert [(r.id, r.status) for r in got] == [(0, "closed")]


def test_live_status_ends(spark, folder):
    hour = 3600
    rows = [
        [(0, 1, "k", "open"), (5, 2, "j", "open")],
        [(10, 3, "k", "closed")],
        [(8, 4, "k", "late")],
        [(30 * hour, 5, "j", "closed")],
        [(40 * hour, None, None, None)],
        [(70 * hour, None, None, None)],
    ]
    got = jobs.run_available(stateful.live_status(stream_of(spark, folder, rows, "ts id key status")), folder, "update").collect()
    want = [("j", 5, "open", False), ("j", 30 * hour, "closed", False), ("j", 30 * hour, "closed", True),
            ("k", 0, "open", False), ("k", 10, "closed", False), ("k", 10, "closed", True)]
    assert seconds(got, "key", "ts", "status", "expired") == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))


def messages(seed, n=240):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, old = [], []
    for i in range(n):
        if old and rnd.random() < 0.5:
            text = list(rnd.choice(old[-12:]))
            for _ in range(rnd.randrange(4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        else:
            text = [rnd.choice(words) for _ in range(rnd.randrange(1, 25))]
        old.append(text)
        rows.append((i * 60 + rnd.randrange(60), i, " ".join(text)))
    return rows


def test_near_duplicates_of_a_stream_equal_those_of_the_batch(spark, folder):
    rows = messages(4)
    rnd = random.Random(4)
    late = sorted(rows, key=lambda r: r[0] + (1800 if rnd.random() < 0.1 else 0))
    cuts = [late[i : i + 20] for i in range(0, len(late), 20)]
    assert len(cuts) >= 12
    stream = stream_of(spark, folder, cuts, "ts id text")
    pairs = jobs.run_available(stateful.near_duplicate_candidates(stream, "id", "text", "ts"), folder).distinct()
    df = spark.createDataFrame([(START + t, i, x) for t, i, x in rows], "ts bigint, id bigint, text string").withColumn("ts", F.timestamp_seconds("ts"))
    got = sorted(map(tuple, identity.similar_pairs(pairs, df, "id", "text").collect()))
    want = sorted(map(tuple, identity.near_duplicates(df, "id", "text", "ts").collect()))
    assert got == want and len(want) > 50


def test_state_of_near_duplicates_ends(spark, folder):
    rows = [[(i * 10 + j, i * 10 + j, f"some words of number {i} and {j} {i * j}") for j in range(10)] for i in range(4)]
    rows += [[(9000 + 3600 * k, None, None)] for k in range(3)]
    stream = stream_of(spark, folder, rows, "ts id text")
    writer = stateful.near_duplicate_candidates(stream, "id", "text", "ts").writeStream.trigger(availableNow=True)
    query = jobs.started(writer.option("checkpointLocation", f"{folder}/c").format("noop"), spark)
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) > 20 and sizes[-1] == 0


def test_rows_beyond_the_delay_are_left_out(spark, folder):
    hour = 3600
    rows = [[(0, "a", "x", 1)], [(10 * hour, "a", "x", 1)], [(11 * hour, "a", "x", 1)], [(hour, "a", "x", 3)], [(50 * hour, None, None, None)]]
    got = jobs.run_available(stateful.resolved_incidents(stream_of(spark, folder, rows, "ts type area rank")), folder).collect()
    assert seconds(got, "first", "n", "severity") == [(0, 1, 1), (10 * hour, 2, 1)]


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with jobs.session_settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.quernstone.test": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.quernstone.test", None) is None


def test_a_channel_far_ahead_does_not_hold_up_others(spark, folder):
    path, checkpoint = f"{folder}/logs", f"{folder}/polls/checkpoint"
    start = F.timestamp_seconds(F.lit(START))
    rows = spark.range(1000).select(F.lit("far ahead").alias("channel"), "id", start.alias("ts"), F.lit("x").alias("text"))
    few = spark.range(3).select(F.lit("few").alias("channel"), (F.col("id") + 5000).alias("id"), start.alias("ts"), F.lit("y").alias("text"))
    channels.append(rows.unionByName(few), path)

    def poll():
        return jobs.run_available(channels.read_channels(spark, path, checkpoint, limit=100, part=30), folder, "update", run="polls")

    first = poll()
    assert {(r.channel, r["n"]) for r in first.groupBy("channel").agg(F.count("*").alias("n")).collect()} == {("far ahead", 100), ("few", 3)}
    assert first.filter("channel = 'far ahead'").agg(F.max("id")).first()[0] == 99
    for _ in range(3):
        poll()
    channels.append(few.withColumn("id", F.col("id") + 100), path)
    last = poll()
    assert last.filter("channel = 'few'").count() == 6 and last.filter("channel = 'far ahead'").count() == 500
    assert last.select("channel", "id").distinct().count() == 506


def test_channel_offsets(spark, folder, tmp_path):
    reader = channels.ChannelReader({"path": str(tmp_path / "none"), "checkpoint": str(tmp_path / "c")}, None)
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    offsets = tmp_path / "c" / "offsets"
    offsets.mkdir(parents=True)
    for n, end in ((9, 5), (10, 7)):
        (offsets / str(n)).write_text("v1\n{}\n" + json.dumps({"a": end}))
    assert channels.ChannelReader({"path": "x", "checkpoint": str(tmp_path / "c")}, None)._planned() == {"a": 7}
