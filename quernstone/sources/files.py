"""File sources and sinks: JSON, CSV, GeoJSON, feeds, chunks, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that hold an array, an object with ``data``, or one with ``data.results``."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = T.ArrayType(schema)
    whole = F.when(F.col("v").startswith("["), F.from_json("v", rows))
    inner = F.from_json(F.get_json_object("v", "$.data"), rows)
    nested = F.from_json(F.get_json_object("v", "$.data.results"), rows)
    return raw.select(F.coalesce(whole, nested, inner).alias("r")).select(F.inline("r"))


def read_category(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """All files of a category; unreadable ones are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With header, quoted fields, doubled quotes, and line breaks inside quotes."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties as JSON text, kind, lat, lon): points as they are, lines at their
    middle vertex, polygons at the mean of their outer ring."""
    from ..functions.geo import line_middle, ring_mean

    raw = spark.read.text(path, wholetext=True)
    feature = T.StructType([T.StructField("geometry", T.StringType()), T.StructField("properties", T.StringType())])
    features = raw.select(F.inline(F.from_json(F.get_json_object("value", "$.features"), T.ArrayType(feature))))
    kind = F.get_json_object("geometry", "$.type")
    at = F.get_json_object("geometry", "$.coordinates")
    point, line = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
    centre = (
        F.when(kind == "Point", F.from_json(at, point))
        .when(kind == "LineString", line_middle(F.from_json(at, line)))
        .when(kind == "Polygon", ring_mean(F.element_at(F.from_json(at, T.ArrayType(line)), 1)))
    )
    return features.select("properties", kind.alias("kind"), centre.alias("c")).select("properties", "kind", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


def feed_items(raw: DataFrame, column: str, key: str) -> DataFrame:
    """Items and entries of RSS and Atom texts: key, guid, title, link, published, body."""
    pattern = "(?is)<(?:item|entry)[ >].*?</(?:item|entry)>"
    items = raw.select(key, F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("x"))

    def field(*tags: str) -> Column:
        return F.coalesce(*(tx.decode_entities(tx.strip_cdata(tx.tag_content(F.col("x"), t))) for t in tags))

    href = F.nullif(F.regexp_extract("x", "(?is)<link[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    return items.select(
        key, field("guid", "id").alias("guid"), field("title").alias("title"), F.coalesce(field("link"), href).alias("link"),
        field("pubDate", "published", "updated").alias("published"), tx.strip_markup(field("description", "summary", "content")).alias("body"),
    )


def read_chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Parquet chunks under ``chunk=N`` folders; the range counts from 1, both ends included."""
    df = spark.read.parquet(path)
    if first is not None and last is not None and not 1 <= first <= last:
        raise ValueError("a range of chunks begins at 1 and ends no earlier")
    if first is not None:
        df = df.filter(F.col("chunk") >= first)
    return df if last is None else df.filter(F.col("chunk") <= last)


def decode_delta_rows(rows: DataFrame, key: str, ordinal: str, values: str, repeats: str, nulls: str, names: list[str]) -> DataFrame:
    """Rows whose values are given as differences to the row before.

    Bit i of ``repeats`` takes column i from the row before, bit i of ``nulls``
    makes it NULL, else it is the next of ``values``.  Columns come out by
    carrying the last given value forward, NULLs marked apart.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for i, name in enumerate(names):
        bit = F.lit(1 << i)
        repeated = F.col(repeats).bitwiseAND(bit) != 0
        null = F.col(nulls).bitwiseAND(bit) != 0
        before = F.lit((1 << i) - 1)
        given = F.lit(i) - F.bit_count(F.col(repeats).bitwiseOR(F.col(nulls)).bitwiseAND(before))
        value = F.when(~repeated, F.struct(F.when(~null, F.get(values, given)).alias("v")))
        out = out.withColumn(name, F.last(value, ignorenulls=True).over(order)["v"])
    return out.select(key, ordinal, *names)


def write_gzip_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def export(df: DataFrame, path: str, time: str, kind: str = "json") -> None:
    """NDJSON or CSV files whose order by time is that of their names."""
    df.repartitionByRange(F.col(time).asc()).sortWithinPartitions(time).write.mode("overwrite").option("header", "true").format(kind).save(path)


def write_geojson(df: DataFrame, path: str, *properties: str) -> None:
    """One feature a line; rows without coordinates are left out."""
    from ..functions.geo import feature

    rows = df.filter("lat is not null and lon is not null")
    rows.select(feature(F.col("lat"), F.col("lon"), **{p: F.col(p) for p in properties}).alias("value")).write.mode("overwrite").text(path)


def catalog(spark: SparkSession) -> dict[str, bool]:
    """Tables and views by name, and whether each is temporary."""
    return {t.name: t.isTemporary for t in spark.catalog.listTables()}
