"""Canonical record schema, domains and rank maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "date": T.DateType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(fields: str) -> T.StructType:
    """A struct of plain types; parsed here, as Spark's parser needs a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


LOCATION = _struct(
    "name string, governorate string, region string, lat double, lon double, precision string,"
    " gazetteer_key string, admin1 string, admin2 string, admin2_pcode string"
)
METRICS = _struct(
    "killed double, injured double, displaced double, affected double, demolished double,"
    " detained double, count double, value double, unit string"
)
QUALITY = _struct(
    "score double, completeness double, consistency double, accuracy double, confidence string, verified boolean"
)
SOURCE = _struct("name string, organization string, url string, license string, fetched_at timestamp")
CONTEXT = _struct("days_since_baseline int, baseline_date date, conflict_phase string")

CANONICAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("stable_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("metrics", METRICS),
        T.StructField("description", T.StringType()),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("severity_index", T.DoubleType()),
        T.StructField("temporal_context", CONTEXT),
        T.StructField("quality", QUALITY),
        T.StructField("sources", T.ArrayType(SOURCE)),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    ]
)
SCHEMA_VERSION = "3.0.0"

#: Fixed domain of regions; what is outside counts as unknown.
REGIONS = ("gaza", "west_bank", "east_jerusalem", "unknown")

#: Severities from low to high.
SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """0 to 3; NULL for what is no severity."""
    return F.when(severity.isin(*SEVERITIES), F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def _default(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.DoubleType):
        return F.lit(0.0)
    return F.lit(None).cast(field.dataType)


def with_defaults(df, name: str, struct: T.StructType, given: dict[str, Column]):
    """``df`` with a struct column in which fields that are not given, or null, get defaults.

    Numbers default to 0, everything else to NULL; fields outside ``struct`` are
    an error, as they belong into ``extras``.
    """
    unknown = set(given) - set(struct.names)
    if unknown:
        raise ValueError(f"not in {name}: {sorted(unknown)}")
    fields = [
        F.coalesce(given[f.name].cast(f.dataType), _default(f)).alias(f.name) if f.name in given else _default(f).alias(f.name)
        for f in struct
    ]
    return df.withColumn(name, F.struct(*fields))
