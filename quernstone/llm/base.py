"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import release_scratch, scratch_path, scratch_scope


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows is recomputed from these files when an
    executor is lost, and expensive Python stages run once.  The files stay
    until ``release_stages`` or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_stages() -> None:
    """Delete all tables written by ``staged`` in this driver."""
    release_scratch()


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``staged`` of what ``make`` returns, without the tables that were written for it."""
    with scratch_scope() as outside:
        df = make()
        with outside():
            return staged(df, name)


def bounded_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """``df``; from now on its session hands Python workers batches of about ``size``.

    Batches of 10,000 rows, as by default, are a hundred megabytes and more where
    documents are long, several times over in the JVM, in Arrow and in Python.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, share: int = 500) -> DataFrame:
    """``rows`` inner-joined with one row of ``groups`` for each value of ``keys``.

    Groups of more than one in ``share`` of all rows, of which there are fewer
    than ``share``, go to every task; the rest is joined by a shuffle in which
    no key has many rows.  ``size_col`` counts the rows of a group.
    """
    large = groups.filter(F.col(size_col) * share > rows.count()).limit(share).collect()  # bounded
    if not large:
        return rows.join(groups, keys)
    large = F.broadcast(rows.sparkSession.createDataFrame(large, groups.schema))
    return rows.join(large, keys, "left_anti").join(groups, keys).unionByName(rows.join(large, keys))


def free_names(df: DataFrame, *words: str) -> list[str]:
    """A column name for each of ``words`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(c for i in range(len(taken) + 1) if (c := f"__{w}{i}") not in taken) for w in words]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
