"""Sorting, pages, projections and capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_page(page: int | None, limit: int | None, default: int = 50, most: int = 500) -> tuple[int, int]:
    return max(1, page or 1), min(most, max(1, limit or default))


def ordering(column: str, descending: bool = False) -> Column:
    """NULLs last either way."""
    c = F.col(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def page_of(df: DataFrame, order: list[Column], page: int | None = 1, limit: int | None = None, **clamp: int) -> DataFrame:
    """One page in a total order; only the first pages' rows reach the driver's merge."""
    page, limit = clamp_page(page, limit, **clamp)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / limit))


def select_fields(df: DataFrame, fields: str | None) -> DataFrame:
    """Comma-separated columns; unknown names are ignored, None keeps all."""
    if not fields:
        return df
    names = [f.strip() for f in fields.split(",")]
    return df.select(*[n for n in dict.fromkeys(names) if n in df.columns])


def newest(df: DataFrame, keep: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first ``keep`` rows of each key (of all rows without keys)."""
    if not by:
        return df.orderBy(*order).limit(keep)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= keep).drop("__rank")


def merged_top(frames: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of all frames together, and whether there were more (``truncated``)."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    # one row more than asked for tells; the windows see no others
    first = merged.orderBy(*order).limit(limit + 1)
    every = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(*order))
    rows = first.withColumns({"truncated": F.count(F.lit(1)).over(every) > limit, "__nth": nth})
    return rows.filter(F.col("__nth") <= limit).drop("__nth")


def capped_list(value: Column, keep: int) -> Column:
    """At most ``keep`` smallest values of a group, sorted."""
    return F.slice(F.sort_array(F.collect_list(value)), 1, keep)
