import random
from collections import deque

from quernstone.operators import reports

SCHEMA = "id int, reporter string, seconds double, key string, status string, lat double, lon double"


def test_only_what_is_taken_counts(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "b", None]), float(rnd.randrange(600)), "k", "open", None, None) for i in range(400)]
    got = {r.id: r.taken for r in reports.taken_in_turn(spark.createDataFrame(rows, SCHEMA).repartition(5), "reporter", "seconds", "id", 4, 30.0).collect()}
    last, want = {}, {}
    for i, who, t, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        held = last.setdefault(who, deque(maxlen=4))
        want[i] = who is None or len(held) < 4 or t - held[0] > 30
        if want[i]:
            held.append(t)
    assert got == want and sum(not v for v in want.values()) > 50


def test_outcomes(spark):
    places = spark.createDataFrame([("cp1", 31.0, 35.0), ("cp2", 31.1, 35.0)], "key string, p_lat double, p_lon double")
    rows = [
        (1, "a", 0.0, "cp1", "open", None, None),
        (2, "a", 1.0, None, "closed", 31.1001, 35.0),
        (3, "a", 2.0, "other", "closed", 31.0001, 35.0),  # an unknown key near a place
        (4, "a", 3.0, "other", "closed", 31.05, 35.0),
        (5, "a", 4.0, None, "closed", 31.05, 35.0),
        (6, "a", 5.0, " ", "closed", None, 35.0),
        (7, "a", 6.0, "cp1", "gone", None, None),
        (8, "a", 7.0, "cp1", None, None, None),
        *((100 + i, "b", i * 5.0, "cp2", "open", None, None) for i in range(14)),
    ]
    got = {r.id: (r.outcome, r.place) for r in reports.user_reports(spark.createDataFrame(rows, SCHEMA), places).collect()}
    assert [got[i] for i in range(1, 9)] == [
        ("applied", "cp1"), ("applied", "cp2"), ("applied", "cp1"), ("candidate", None), ("recorded", None), ("recorded", None), ("invalid", None), ("invalid", None),
    ]
    # the tenth lies 45 seconds after the first; the fourteenth comes 65 seconds after it
    assert [got[100 + i][0] for i in range(14)] == ["applied"] * 10 + ["rate_limited"] * 3 + ["applied"]
    assert reports.user_reports(spark.createDataFrame([], SCHEMA), places).collect() == []
    assert {r.outcome for r in reports.user_reports(spark.createDataFrame(rows[:3], SCHEMA), places.limit(0)).collect()} == {"candidate", "recorded"}
