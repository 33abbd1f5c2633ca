"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

Owned = list[tuple[SparkSession, str]]
_driver: Owned = []
#: What the current thread or task of the driver has asked for; other threads do not see it.
_owner: ContextVar[Owned | None] = ContextVar("scratch_owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset: then a temporary folder is
    taken.  On a cluster no folder of one machine would do, so that is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below it of its own, deleted with its scope or at the end of the driver."""
    path = f"{shared_folder(spark).rstrip('/')}/quernstone/{name}-{uuid.uuid4().hex}"
    owner = _owner.get()
    (_driver if owner is None else owner).append((spark, path))
    return path


def _release(owned: Owned) -> None:
    """Delete these paths; one that cannot be deleted keeps none of the others."""
    while owned:
        spark, path = owned.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _owned_by(owned: Owned | None) -> Iterator[None]:
    token = _owner.set(owned)
    try:
        yield
    finally:
        _owner.reset(token)


@contextmanager
def scratch_scope() -> Iterator[Callable]:
    """Paths asked for inside, by this thread, are deleted at the end, also after an error.

    It gives a context in which paths belong to whatever is around the scope.
    """
    owned: Owned = []
    outside = _owner.get()
    try:
        with _owned_by(owned):
            yield lambda: _owned_by(outside)
    finally:
        _release(owned)


def release_scratch() -> None:
    """Delete the paths that belong to the driver."""
    _release(_driver)


atexit.register(release_scratch)
