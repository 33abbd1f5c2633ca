import os
import threading

import pytest

from quernstone import scratch


def written(spark, name):
    path = scratch.scratch_path(spark, name)
    spark.range(3).write.parquet(path)
    return path.removeprefix("file://")


def test_scope_deletes_its_own_paths_only(spark):
    before = written(spark, "before")
    with scratch.scratch_scope() as outside:
        inner = written(spark, "inner")
        with outside():
            kept = written(spark, "kept")
        with scratch.scratch_scope() as middle:
            deep = written(spark, "deep")
            with middle():
                handed_on = written(spark, "handed-on")
        assert not os.path.exists(deep) and os.path.exists(handed_on) and os.path.exists(inner)
    assert [os.path.exists(p) for p in (before, inner, kept, handed_on)] == [True, False, True, False]


def test_scope_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), scratch.scratch_scope():
        path = written(spark, "failed")
        1 / 0
    assert not os.path.exists(path)


def test_two_threads_leave_each_other_alone(spark):
    """The first to finish deletes nothing of the other."""
    inside, done = threading.Event(), threading.Event()
    found = []

    def slow():
        with scratch.scratch_scope():
            path = written(spark, "slow")
            inside.set()
            done.wait(60)
            found.append(spark.read.parquet(path).count())

    other = threading.Thread(target=slow)
    other.start()
    inside.wait(60)
    with scratch.scratch_scope():
        written(spark, "fast")
    done.set()
    other.join()
    assert found == [3]


def test_a_path_that_cannot_be_deleted_keeps_no_other(spark):
    path = written(spark, "good")
    owned = [(spark, path), (None, "nowhere")]
    scratch._release(owned)
    assert not os.path.exists(path) and owned == []
