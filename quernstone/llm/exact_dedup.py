"""Exact dedup by deterministic block naming (DataFrame functions only).

Texts are cut into blocks of ``block_bytes`` bytes.  Distinct blocks are sorted
and their positions become integer names; adjacent names are then paired and
the distinct pairs are sorted and named in turn, until one name stands for each
document.  Two documents get the same (level, name) exactly if their texts are
byte for byte equal: a name stands for one block or one pair only, and texts
with different numbers of halvings end on different levels.

Rows travel to the names by a 64-bit hash of the block, not by the block.  This
is exact: the naming step has the blocks themselves, so it knows every hash
that two different blocks share, and those blocks are looked up by content.

Names are positions in hash-partitioned, locally sorted data: no global sort and
no task sees more than its share.  Copies meet in names that are distinct
already, so a group that holds a third of all rows costs a join with one row on
its other side, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import attach, free_names, staged

#: Bytes of a block.  Most documents are a few blocks; names take a row each.
BLOCK_BYTES = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Names for rows that are distinct in ``keys``: their sorted positions."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(content: Column, block_bytes: int) -> Column:
    last = F.floor((F.greatest(F.octet_length(content), F.lit(1)) - 1) / block_bytes).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(content, i * block_bytes + 1, F.lit(block_bytes)),
    )


def block_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Level 0: (rid, pos, last, sha, name) for (rid, content, sha) rows."""
    cut = rows.select(
        "rid",
        "sha",
        F.floor((F.greatest(F.octet_length("content"), F.lit(1)) - 1) / block_bytes).cast("int").alias("last"),
        F.posexplode(_blocks(F.col("content"), block_bytes)).alias("pos", "block"),
    )
    first_sha = F.when(F.col("pos") == 0, F.col("sha")).alias("sha")
    named = _named(cut.select("block").distinct(), ["block"])
    names = staged(named.select(route(F.col("block")).alias("route"), "name"), "block-names")
    shared = names.groupBy("route").count().filter("count > 1").select("route")
    routed = cut.withColumn("route", route(F.col("block")))
    if shared.isEmpty():
        return routed.select("rid", "pos", "last", first_sha, "route").join(names, "route").drop("route")
    # Different blocks with one hash: those routes are looked up by content.
    shared = shared.withColumn("is_shared", F.lit(True))
    content_if_shared = F.when(F.col("is_shared"), F.col("block")).otherwise(F.lit("").cast("binary")).alias("exact")
    by_content = _named(
        cut.select("block").distinct().withColumn("route", route(F.col("block"))).join(shared, "route"), ["block"]
    ).select("route", F.col("block").alias("exact"), (F.lit(-2) - F.col("name")).alias("name"))
    by_hash = names.join(shared, "route", "left_anti").select("route", F.lit("").cast("binary").alias("exact"), "name")
    every = staged(by_hash.unionByName(by_content), "block-names")
    return (
        routed.join(shared, "route", "left")
        .select("rid", "pos", "last", first_sha, "route", content_if_shared)
        .join(every, ["route", "exact"])
        .drop("route", "exact")
    )


def identities(
    rows: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(rid, level, name, sha) for (rid, content, sha) rows.

    ``rid`` must be unique.  Null content is not expected here.
    """
    current = staged(block_names(rows, block_bytes, route), "level-0")
    longest = current.agg(F.max("last")).first()[0] or 0
    done = current.filter("last = 0").select("rid", F.lit(0).alias("level"), "name", "sha")
    current = current.filter("last > 0")
    level = 0
    while longest > 0:
        level += 1
        pairs = current.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("sha").alias("sha"),
            F.first(F.expr("last div 2").cast("int")).alias("last"),
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("left"),
            # no name is -1, which marks the missing right half
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("right"),
        )
        pairs = staged(pairs, f"pairs-{level}")
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"])
        current = staged(pairs.join(names, ["left", "right"]).select("rid", "pos", "last", "sha", "name"), f"level-{level}")
        done = done.unionByName(current.filter("last = 0").select("rid", F.lit(level).alias("level"), "name", "sha"))
        current = current.filter("last > 0")
        longest //= 2
    return done


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: its group of equal texts and the row that stays.

    Returns ``id_col``, keep_id, group_size, kept, text_sha256.

    * Null text counts as the empty text; empty texts are equal to each other.
    * The largest id of a group stays (a null id only if the group has no
      other).  If rows repeat that id, each of them gets its own output row;
      exactly one is ``kept``.
    * An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("content"),
    )
    # the id rides along as part of the row's key, the digest with block 0
    keyed = rows.select(
        F.struct("rid", "doc").alias("rid"), "content", F.unhex(F.sha2("content", 256)).alias("sha")
    )
    named = identities(keyed, block_bytes, route).select(
        F.col("rid.rid").alias("rid"), F.col("rid.doc").alias("doc"), "level", "name", "sha"
    )
    groups = staged(
        named.groupBy("level", "name").agg(
            F.max("doc").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct("doc", "rid")).getField("rid").alias("keep_rid"),
        ),
        "groups",
    )
    return attach(named, groups, ["level", "name"], "group_size").select(
        F.col("doc").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def digest_of(text: Column) -> Column:
    """SHA-256 of the text as ``exact_dedup`` sees it."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def one_of_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, sha, n) of ``chosen``, of which ``docs`` has n rows.

    Rows are met by id, null or not, and digest, so neither ids nor rows need be unique.
    """
    sha, copy, its_id, its_sha = free_names(docs, "sha", "copy", "id", "same")
    marked = docs.withColumn(sha, digest_of(F.col(text_col)))
    same = (F.col(sha) == F.col(its_sha)) & F.col(id_col).eqNullSafe(F.col(its_id))
    alone, repeated = (
        chosen.filter(c).select(F.col("id").alias(its_id), F.col("sha").alias(its_sha)) for c in ("n = 1", "n > 1")
    )
    kept = marked.join(alone, same, "left_semi").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    # combined before the shuffle, so that a row that repeats very often is no load
    firsts = (
        marked.join(repeated, same, "left_semi")
        .groupBy(id_col, sha)
        .agg(F.first(F.struct(*docs.columns)).alias(copy))
        .select(*(F.col(copy).getField(c).alias(c) for c in docs.columns))
    )
    return kept.unionByName(firsts)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, one with the largest id.

    Ids may repeat or be null; of rows that repeat the id and the text, any one stays.
    """
    found = exact_dedup(docs.select(id_col, text_col), id_col, text_col)
    chosen = (
        found.filter(F.col(id_col).eqNullSafe(F.col("keep_id")))
        .groupBy(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return one_of_each(docs, staged(chosen, "exact-chosen"), id_col, text_col)


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
