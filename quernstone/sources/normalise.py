"""Turning upstream rows into canonical columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *synonyms: str) -> Column:
    """The first synonym column with text; NULL if the table has none of them."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in synonyms if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def number(text: Column) -> Column:
    """Without thousands commas and blanks; NULL for what is no number."""
    return F.regexp_replace(text.cast("string"), "[, ]", "").try_cast("double")


def column_sum(df: DataFrame, pattern: str) -> Column:
    """Sum of all columns whose name matches; NULL where none has a value."""
    names = [c for c in df.columns if re.search(pattern, c)]
    if not names:
        return F.lit(None).cast("double")
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in names))
    return F.when(F.coalesce(*map(F.col, names)).isNotNull(), total)


def normalised(df: DataFrame, columns: dict[str, tuple[str, ...]], numbers: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns from synonyms; some parsed as numbers or dates."""
    from ..functions.dates import normalised_date

    out = []
    for name, synonyms in columns.items():
        c = pick(df, *synonyms)
        c = number(c) if name in numbers else normalised_date(c) if name in dates else c
        out.append(c.alias(name))
    return df.select(*out)
