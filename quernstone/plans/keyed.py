"""Queries on keyed tables: base files, numbered change batches, and what a read makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..sources.keyed_table import PUT, REMOVE, KeyedTable
from .base import alerts, econ, entities, query, table, updates

#: Batches of a table's changes.
BATCHES = 20


def _applied(keyed: KeyedTable, changes: DataFrame, batch: str, order: str, op: str | None = None, compact: int | None = None) -> None:
    """All batches in turn; one is compacted after, and earlier ones are applied once more, which changes nothing."""
    for b in range(BATCHES):
        rows = changes.filter(F.col(batch) == b)
        keyed.apply(b, rows, order, op)
        if b == compact:
            keyed.compact()
            keyed.apply(b - 2, rows, order, op)
    keyed.apply(BATCHES - 1, changes, order, op)


_CORRECTED = """a AS (SELECT id, type, confidence, k, CAST(id % 10 AS BIGINT) * 2 AS batch FROM v_alerts)"""


def _corrected(spark, d) -> KeyedTable:
    """Alerts come in even batches; later ones correct the type, retract, delete, and put some back."""
    a = alerts(spark, d).select("id", "type", "confidence", "k", (F.col("id") % 10 * 2).alias("batch"))
    null = lambda kind: F.lit(None).cast(kind)
    shape = lambda rows, op, status, kind=None, confidence=None, later=1: rows.select(
        "id", (kind if kind is not None else null("string")).alias("type"), F.lit(status).alias("status"),
        (confidence if confidence is not None else null("double")).alias("confidence"), (F.col("batch") + later).alias("batch"), F.lit(op).alias("op"),
    )
    changes = shape(a, PUT, "active", F.col("type"), F.col("confidence"), 0)
    changes = changes.unionByName(shape(a.filter("k % 9 = 0"), PUT, None, F.concat(F.lit("was "), "type"), F.lit(0.99)))
    changes = changes.unionByName(shape(a.filter("k % 5 = 0 and batch < 17"), PUT, "retracted", later=2))
    changes = changes.unionByName(shape(a.filter("k % 20 = 0 and batch < 17"), REMOVE, None, later=3))
    changes = changes.unionByName(shape(a.filter("k % 40 = 0 and batch < 14"), PUT, "restored", F.lit("again"), later=5))
    keyed = KeyedTable(spark, scratch_path(spark, "alerts"), ["id"], {"type": "last", "status": "last", "confidence": "max"})
    _applied(keyed, changes, "batch", "id", "op", compact=9)
    return keyed


@query("r16_corrections", f"""WITH {_CORRECTED}
SELECT id, CASE WHEN k % 40 = 0 AND batch < 14 THEN 'again' WHEN k % 9 = 0 THEN 'was ' || type ELSE type END AS type,
 CASE WHEN k % 40 = 0 AND batch < 14 THEN 'restored' WHEN k % 5 = 0 AND batch < 17 THEN 'retracted' ELSE 'active' END AS status,
 CASE WHEN k % 40 = 0 AND batch < 14 THEN NULL WHEN k % 9 = 0 THEN greatest(confidence, 0.99::DOUBLE) ELSE confidence END AS confidence
FROM a WHERE NOT (k % 20 = 0 AND batch < 17) OR (k % 40 = 0 AND batch < 14)""")
def corrections(spark, d):
    return _corrected(spark, d).read()


@query("r16_change_feed", f"""WITH {_CORRECTED},
old AS (SELECT id, status, type FROM (SELECT id, CASE WHEN k % 5 = 0 AND batch + 2 <= 11 THEN 'retracted' ELSE 'active' END AS status,
  CASE WHEN k % 9 = 0 AND batch + 1 <= 11 THEN 'was ' || type ELSE type END AS type, k, batch FROM a WHERE batch <= 11) WHERE NOT (k % 20 = 0 AND batch + 3 <= 11)
  UNION ALL SELECT id, 'restored', 'again' FROM a WHERE k % 40 = 0 AND batch + 5 <= 11),
new AS (SELECT id, CASE WHEN k % 40 = 0 AND batch < 14 THEN 'again' WHEN k % 9 = 0 THEN 'was ' || type ELSE type END AS type,
 CASE WHEN k % 40 = 0 AND batch < 14 THEN 'restored' WHEN k % 5 = 0 AND batch < 17 THEN 'retracted' ELSE 'active' END AS status
 FROM a WHERE NOT (k % 20 = 0 AND batch < 17) OR (k % 40 = 0 AND batch < 14))
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change, n.status
FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.status <> n.status OR o.type <> n.type""")
def change_feed(spark, d):
    """What the last eight batches changed, as events to push."""
    return _corrected(spark, d).feed(11).select("id", "change", F.col("new.status").alias("status"))


@query("u12_entity_upsert", """
WITH e AS (SELECT id, CASE WHEN id % 11 <> 0 THEN name END AS name, age, 'ds' || CAST(id % 3 AS VARCHAR) AS dataset, (id * 7 % 10) / 10.0::DOUBLE AS confidence, id % 20 AS batch FROM v_entities),
k AS (SELECT *, coalesce(name, 'id:' || CAST(id AS VARCHAR)) AS key FROM e),
s AS (SELECT key, dataset, min(struct_pack(b := batch, i := id)) AS f FROM k GROUP BY 1, 2)
SELECT k.key, arg_min(name, struct_pack(b := batch, i := id)) AS name, arg_min(age, struct_pack(b := batch, i := id)) FILTER (WHERE age IS NOT NULL) AS age, max(confidence) AS confidence,
 (SELECT string_agg(dataset || '@' || CAST(f.i AS VARCHAR), ',' ORDER BY f) FROM s WHERE s.key = k.key) AS attributions FROM k GROUP BY k.key""")
def entity_upsert(spark, d):
    """People from three datasets in 20 batches: named ones are merged, others stand for themselves."""
    e = entities(spark, d)
    name = F.when(F.col("id") % 11 != 0, F.col("name"))
    rows = e.select(
        F.coalesce(name, F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("key"), name.alias("name"), "age", "id",
        (F.col("id") * 7 % 10 / F.lit(10.0)).alias("confidence"), (F.col("id") % BATCHES).alias("batch"),
        F.array(F.struct(F.concat(F.lit("ds"), (F.col("id") % 3).cast("string")).alias("dataset"), F.col("id").alias("record"))).alias("attributions"),
    )
    rules = {"name": "first", "age": "first", "confidence": "max", "attributions": "union:dataset"}
    keyed = KeyedTable(spark, scratch_path(spark, "people"), ["key"], rules)
    _applied(keyed, rows, "batch", "id", compact=12)
    shown = F.array_join(F.transform("attributions", lambda a: F.concat(a["dataset"], F.lit("@"), a["record"].cast("string"))), ",")
    return keyed.read().withColumn("attributions", shown)


@query("u19_canonical_merge", """
WITH m AS (SELECT CASE WHEN key = 'cp1' THEN 'cp2' ELSE key END AS key, direction, status, ts, id FROM v_updates) SELECT key, direction, count(*) AS n, max(ts) AS latest, arg_max(status, struct_pack(t := ts, i := id)) AS status FROM m GROUP BY 1, 2""")
def canonical_merge(spark, d):
    """A key is renamed in the middle of 20 batches: its history goes to the other name, and so do later reports of it."""
    newest = F.struct("ts", "id", "status").alias("latest")
    rows = updates(spark, d).select("key", "direction", "id", F.lit(1).cast("bigint").alias("n"), newest, (F.col("id") % BATCHES).alias("batch"))
    keyed = KeyedTable(spark, scratch_path(spark, "places"), ["key", "direction"], {"n": "sum", "latest": "max"})
    names = rows.select("direction").distinct().select(F.lit("cp1").alias("key"), "direction", F.lit("cp2").alias("to_key"), F.col("direction").alias("to_direction"))
    half = BATCHES // 2
    for b in range(BATCHES):
        now = rows.filter(F.col("batch") == b)
        if b >= half:
            now = now.withColumn("key", F.when(F.col("key") == "cp1", "cp2").otherwise(F.col("key")))
        keyed.apply(b + (b >= half), now, "id")
        if b == half - 1:
            keyed.rename(half, names, F.lit(0).cast("bigint"))
            keyed.compact()
    return keyed.read().select("key", "direction", "n", "latest.ts", "latest.status").withColumnRenamed("ts", "latest")


@query("u03_upsert_log", "WITH f AS (SELECT indicator, year, floor(value / 2) AS value FROM v_econ WHERE year >= 1999) SELECT * FROM v_econ WHERE year < 1999 UNION ALL SELECT * FROM f")
def upsert_log(spark, d):
    """The upsert of ``u03`` as two batches of a keyed table."""
    e = econ(spark, d)
    keyed = KeyedTable(spark, scratch_path(spark, "indicators"), ["indicator", "year"], {"value": "last"})
    keyed.apply(0, e, F.lit(0))
    keyed.apply(1, e.filter("year >= 1999").withColumn("value", F.floor(F.col("value") / 2).cast("double")), F.lit(0))
    return keyed.read()


@query("u20_archive_log", """
WITH e AS (SELECT doc_id, source, n_chars, 0 AS b FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, source, n_chars, 1 FROM documents)
SELECT n_chars, arg_min(doc_id, struct_pack(b := b, i := doc_id)) AS doc_id, arg_min(source, struct_pack(b := b, i := doc_id)) AS source FROM e WHERE n_chars IS NOT NULL GROUP BY 1""")
def archive_log(spark, d):
    """The archive of ``u20`` as two batches: what is there stays."""
    rows = table(spark, d, "documents").select(F.col("n_chars").cast("bigint").alias("n_chars"), "doc_id", "source")
    keyed = KeyedTable(spark, scratch_path(spark, "archive"), ["n_chars"], {"doc_id": "first", "source": "first"})
    keyed.apply(0, rows.filter("source = 'src0'"), "doc_id")
    keyed.apply(1, rows, "doc_id")
    return keyed.read()
