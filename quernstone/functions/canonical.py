"""Canonical JSON: one text for all ways to write one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths whose values change from run to run or follow from others; ``[]`` stands for an array's elements.
VOLATILE = ("stable_id", "id", "temporal_context.days_since_baseline", "temporal_context.baseline_period", "sources[].fetched_at")


def _ordered(c: Column, kind: T.DataType, path: str, volatile: frozenset[str]) -> Column:
    """``c`` with the fields of structs and the keys of maps in order, at every depth, and no volatile ones."""
    if isinstance(kind, T.StructType):
        at = lambda name: f"{path}.{name}" if path else name
        fields = sorted((f for f in kind if at(f.name) not in volatile), key=lambda f: f.name)
        if not fields:
            return F.when(c.isNotNull(), F.create_map().cast("map<string,string>"))
        made = F.struct(*(_ordered(c.getField(f.name), f.dataType, at(f.name), volatile).alias(f.name) for f in fields))
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType, f"{path}[]", volatile))
    if isinstance(kind, T.MapType):
        held = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _ordered(e["value"], kind.valueType, f"{path}.*", volatile).alias("value")))
        return F.map_from_entries(F.array_sort(held, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def canonical_json(c: Column, kind: T.DataType, volatile: tuple[str, ...] = ()) -> Column:
    """JSON of a struct, array or map: names in order at every depth, NULLs kept, ``volatile`` paths left out.

    A NULL value gives NULL.  Maps have text keys.
    """
    return F.to_json(_ordered(c, kind, "", frozenset(volatile)), {"ignoreNullFields": "false"})


def canonical_text(json: Column) -> Column:
    """A JSON text of any shape with its names in order; NULL if it is no JSON.

    A variant keeps the names of an object sorted, so this needs no schema.
    """
    return F.to_json(F.try_parse_json(json))


def record_id(df: DataFrame, volatile: tuple[str, ...] = VOLATILE, size: int = 32) -> Column:
    """SHA-256 of the canonical JSON of a whole row."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))
    return F.substring(F.sha2(canonical_json(row, df.schema, volatile), 256), 1, size)


def simple_hash(text: Column) -> Column:
    """The 32-bit hash h * 31 + unit over UTF-16 units, its absolute value in base 36; NULL stays NULL."""
    code = lambda c: F.ascii(c).cast("bigint")
    units = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(
        code(c) > 0xFFFF, F.array(F.lit(0xD800) + F.shiftright(code(c) - 0x10000, 10), F.lit(0xDC00) + (code(c) - 0x10000).bitwiseAND(F.lit(0x3FF)))
    ).otherwise(F.array(code(c)))))
    folded = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(folded >= 1 << 31, (1 << 32) - folded).otherwise(folded)
    return F.lower(F.conv(signed.cast("string"), 10, 36))
