"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Each source is dealt to shards, each shard is cut into blocks of nearly equal
numbers of words.  Blocks go to sources by the highest quotients target/(2k-1),
then within each source to its shards in the same way.  A seeded permutation of
a shard's blocks says which of them are taken, and a block is taken at most
twice.  A document's share is what its words have in the blocks taken.

No quotients are listed for blocks that certainly get or certainly miss a seat:
a divisor a little above and one a little below the fair one bound each party's
seats, and only quotients between the two bounds are ranked.  These are a few
for each source, or for each shard of a source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, staged

#: Weights of the sources, in code point order of their names, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all words, and most passes over a source.
SHARE, MOST_PASSES = 1.5, 2
#: Words of a block at most.
BLOCK_WORDS = 64
#: Shards of a source: at least so many, and one for so many documents.
LEAST_SHARDS, DOCS_A_SHARD = 256, 200_000
SEED = 17
#: A prime above any number of blocks of a shard: steps by it visit each block once.
STEP = 2_147_483_647


def _hash(text: Column) -> Column:
    """The first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def apportion(parties: DataFrame, group: list[str], weight: str, cap: str, seats: str, order: str) -> DataFrame:
    """``parties`` with ``quota``: Sainte-Laguë seats within each ``group``.

    ``weight`` sums to about ``seats`` in a group and ``cap`` limits a party's
    seats.  Equal quotients go to the lower ``order``, null last.
    """
    whole = Window.partitionBy(*group)
    half = F.count(F.lit(1)).over(whole) / 2 + 1
    open_ = F.sum(F.when(F.col(weight) < F.col(cap), F.col(weight)).otherwise(0.0)).over(whole)
    bounded = parties.withColumns(
        {
            "__low": F.when(F.col(seats) > 2 * half, F.col(seats) / (F.col(seats) - half)).otherwise(F.lit(1e18)),
            "__high": F.greatest(open_, F.lit(1e-9)) / (F.greatest(open_, F.lit(1e-9)) + half),
        }
    )

    def seats_at(divisor: str) -> Column:
        return F.least(F.col(cap), F.floor(F.col(weight) / F.col(divisor) + 0.5)).cast("bigint")

    counted = bounded.withColumns({"__sure": seats_at("__low"), "__most": seats_at("__high")})
    counted = counted.withColumn("__left", F.col(seats) - F.sum("__sure").over(whole))
    ranked = Window.partitionBy(*group).orderBy(F.desc("__quotient"), F.col(order).asc_nulls_last())
    open_seats = (
        counted.filter("__most > __sure")
        .withColumn("__k", F.explode(F.expr("sequence(__sure + 1, __most)")))
        .withColumn("__quotient", F.col(weight) / (2 * F.col("__k") - 1))
        .withColumn("__rank", F.row_number().over(ranked))
        .filter("__rank <= __left")
    )
    keys = list(dict.fromkeys([*group, order]))
    more = open_seats.groupBy(*keys).agg(F.count(F.lit(1)).alias("__more"))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return counted.alias("p").join(more.alias("m"), on, "left").select(
        *(F.col(f"p.{c}").alias(c) for c in parties.columns),
        (F.col("__sure") + F.coalesce("__more", F.lit(0))).alias("quota"),
    )


def source_targets(sources: DataFrame, weights: tuple, share: float, most: int) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target`` words.

    A source's target is its weight's part of the mix, and at most ``most`` times
    its size; the excess goes to the other sources by weight until none is above.
    There is one row for each source, and these rows are ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    every = Window.partitionBy()
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    need = sources.withColumn("weight", weight).withColumn("need", F.col("source_size") * most / F.col("weight"))
    level = need.withColumn(
        "level",
        (F.sum("source_size").over(every) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        / F.sum("weight").over(rest),
    )
    # the first source that its level does not fill, and all after it, share that level
    fair = F.min(F.when(F.col("level") <= F.col("need"), F.struct("need", F.col("source").isNull(), "source", "level"))).over(every)
    return level.withColumn("fair", fair["level"]).select(
        *sources.columns,
        "weight",
        F.least(F.col("source_size") * float(most), F.coalesce("fair", F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def allotments(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Where each row's words lie in its shard, and what the shard gets.

    Returns id, size, source, source_size, target, stop (place of the row's last
    word), words and blocks and quota of the shard, turn (where its permutation
    begins).
    """
    sizes = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            # rows without an id, or with one id, are dealt by their texts
            F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("mark"),
        ),
        "mix-sizes",
    )
    shards = F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.lit(sizes.count()) / DOCS_A_SHARD)).cast("bigint")
    placed = sizes.withColumn("shard", _hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "mark")) % shards)
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("bigint"))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("source_blocks"))
    targets = source_targets(sources, weights, share, most).withColumns(
        {
            "share": F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0),
            "cap": F.col("source_blocks") * most,
        }
    )
    targets = staged(targets.withColumn("seats", F.round(F.sum("share").over(Window.partitionBy())).cast("bigint")), "mix-targets")
    quotas = apportion(targets.withColumn("all", F.lit(0)), ["all"], "share", "cap", "seats", "source")
    quotas = quotas.select("source", "source_size", "source_blocks", "target", F.col("quota").alias("seats"))
    inside = (
        cells.alias("c")
        .join(quotas.alias("q"), F.col("c.source").eqNullSafe(F.col("q.source")))
        .select("c.source", "shard", "words", "blocks", "source_size", "target", "seats", "source_blocks")
        .withColumns(
            {
                "share": F.when(F.col("source_blocks") > 0, F.col("seats") * F.col("blocks") / F.col("source_blocks")).otherwise(0.0),
                "cap": F.col("blocks") * most,
            }
        )
    )
    plan = staged(
        apportion(inside, ["source"], "share", "cap", "seats", "shard").select(
            "source", "shard", "words", "blocks", "source_size", "target", "quota"
        ),
        "mix-plan",
    )
    in_shard = Window.partitionBy("source", "shard").orderBy(F.col("id").asc_nulls_first(), "size", "mark")
    laid = placed.withColumn("end", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        laid.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard")))
        .select("id", "size", "d.source", "d.shard", F.col("end").alias("stop"), "words", "blocks", "source_size", "target", "quota")
        .withColumn("turn", _hash(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("shard").cast("string"))))
    )


def _times(i: str) -> str:
    """How often block ``i`` is taken."""
    return f"(quota div blocks + if(({i} * {STEP} + turn) % blocks < quota % blocks, 1, 0))"


# block i of n is words floor(i * words / n) to floor((i + 1) * words / n)
_FIRST = "greatest(0, cast(floor(((stop - size) * blocks) div words) as bigint) - 1)"
_LAST = "least(blocks - 1, (stop * blocks) div words)"


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: how many of its words the mix takes.

    Returns ``id_col``, size, source, source_size, target, taken.  ``taken`` is
    at most ``most`` times ``size``.  Words are runs of characters other than
    space and U+0009 to U+000D; null text has none.  A null source is a source.
    Rows with one id, or none, are told apart by their texts, so equal rows fare
    alike or share what one place gets.  No rows, or no words, take nothing.
    """
    taken = f"""
        case when size = 0 then 0 else aggregate(
            sequence({_FIRST}, {_LAST}),
            cast(0 as bigint),
            (sum, i) -> sum
                + greatest(0, least(stop, ((i + 1) * words) div blocks) - greatest(stop - size, (i * words) div blocks))
                * {_times("i")}
        ) end"""
    return allotments(docs, id_col, **options).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", F.expr(taken).cast("bigint").alias("taken")
    )


_word = re.compile(r"[^\x20\x09-\x0D]+")


def _words_between(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words of the ranges, with what stands between words of one range."""
    if ranges == [(0, size)]:
        return text
    spans = [m.span() for m in _word.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: for each pass the rows of ``docs`` with the words it takes.

    A row comes once for each pass that takes any of its words, with all of its
    text if the pass takes all; else neighbouring blocks keep what stands
    between their words and stretches are joined by line feeds.  ``chars_col``
    is set to the new length.  Other columns stay.
    """
    pieces = f"""
        transform(
            filter(sequence({_FIRST}, {_LAST}), i -> {_times("i")} > 0 and
                least(stop, ((i + 1) * words) div blocks) > greatest(stop - size, (i * words) div blocks)),
            i -> struct(
                cast(greatest(0, (i * words) div blocks - (stop - size)) as int) as a,
                cast(least(size, ((i + 1) * words) div blocks - (stop - size)) as int) as b,
                cast({_times("i")} as int) as times))"""
    plan = allotments(docs, id_col, source_col, text_col, **options).filter("size > 0").select("id", "source", "size", "stop", F.expr(pieces).alias("__pieces"))
    same = ["__id", "__source", "__size"]
    keys = {"__id": F.col("id"), "__source": F.col("source"), "__size": F.col("size")}
    # rows alike in all three are numbered, so that each gets one place
    nth = lambda *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    plan = plan.withColumns(keys).withColumn("__nth", nth("stop")).select(*same, "__nth", "__pieces")
    rows = docs.withColumns(
        {"__id": F.col(id_col), "__source": F.col(source_col).cast("string"), "__size": word_count(F.col(text_col))}
    ).withColumn("__nth", nth(F.col(text_col)))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*same, "__nth"]]
    joined = rows.alias("d").join(plan.alias("p"), on).select("d.*", "p.__pieces").filter("size(__pieces) > 0")
    joined = joined.select(*docs.columns, "__size", "__pieces")
    names = bounded_batches(docs).columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, texts = [], []
            sizes, pieces_ = batch.column("__size").to_pylist(), batch.column("__pieces").to_pylist()
            for i, text in enumerate(batch.column(at).to_pylist()):
                for number in range(1, max(p["times"] for p in pieces_[i]) + 1):
                    ranges: list[tuple[int, int]] = []
                    for p in pieces_[i]:
                        if p["times"] >= number:
                            if ranges and ranges[-1][1] == p["a"]:
                                ranges[-1] = (ranges[-1][0], p["b"])
                            else:
                                ranges.append((p["a"], p["b"]))
                    rows_.append(i)
                    texts.append(_words_between(text, ranges, sizes[i]))
            picked = batch.select(names).take(pa.array(rows_, pa.int32()))
            yield picked.set_column(at, text_col, pa.array(texts, picked.column(at).type))

    mixed = joined.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        mixed = mixed.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return mixed


OP10_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark
  FROM documents
), placed AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || mark), 1, 8) AS BIGINT)
         % (SELECT greatest({LEAST_SHARDS}, CAST(ceil(count(*) / {DOCS_A_SHARD}) AS BIGINT)) FROM sizes) AS shard
  FROM sizes
), cells AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS words,
         CAST(ceil(sum(size) / {BLOCK_WORDS}) AS BIGINT) AS blocks
  FROM placed GROUP BY source, shard
), sources AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS source_blocks
  FROM cells GROUP BY source
), weighted AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT) + 1] AS weight
  FROM sources
), levels AS (
  SELECT *, CAST(source_size * {MOST_PASSES} AS DOUBLE) / weight AS need,
         (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}
          - CAST(coalesce(sum(source_size) OVER (ORDER BY CAST(source_size * {MOST_PASSES} AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {MOST_PASSES} AS DOUBLE))
         / sum(weight) OVER (ORDER BY CAST(source_size * {MOST_PASSES} AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), fair AS (
  SELECT level FROM levels WHERE level <= need ORDER BY need, source NULLS LAST LIMIT 1
), targets AS (
  SELECT *, least(CAST(source_size * {MOST_PASSES} AS DOUBLE), coalesce((SELECT level FROM fair), 0) * weight) AS target FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * source_blocks / source_size ELSE 0 END AS share FROM targets
), seats AS (
  SELECT CAST(round(sum(share)) AS BIGINT) AS seats FROM shares
), source_quotas AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY share / (2 * k - 1) DESC, source NULLS LAST, k) AS nth
    FROM (SELECT source, share, unnest(range(1, source_blocks * {MOST_PASSES} + 1)) AS k FROM shares)
  ) WHERE nth <= (SELECT seats FROM seats) GROUP BY source
), inside AS (
  SELECT c.*, s.source_size, s.target, coalesce(q.quota, 0) AS seats,
         CASE WHEN s.source_blocks > 0 THEN CAST(coalesce(q.quota, 0) * c.blocks AS DOUBLE) / s.source_blocks ELSE 0 END AS share
  FROM cells c JOIN shares s ON c.source IS NOT DISTINCT FROM s.source
       LEFT JOIN source_quotas q ON c.source IS NOT DISTINCT FROM q.source
), cell_quotas AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY share / (2 * k - 1) DESC, shard, k) AS nth
    FROM (SELECT source, shard, share, seats, unnest(range(1, blocks * {MOST_PASSES} + 1)) AS k FROM inside)
  ) WHERE nth <= seats GROUP BY source, shard
), plan AS (
  SELECT i.*, coalesce(q.quota, 0) AS quota,
         CAST('0x' || substr(md5('{SEED}/' || coalesce(i.source, '') || '/' || CAST(i.shard AS VARCHAR)), 1, 8) AS BIGINT) AS turn
  FROM inside i LEFT JOIN cell_quotas q ON i.source IS NOT DISTINCT FROM q.source AND i.shard = q.shard
), laid AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY doc_id NULLS FIRST, size, mark ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM placed
)
SELECT l.doc_id, l.size, l.source, p.source_size, p.target,
       CASE WHEN l.size = 0 THEN 0 ELSE CAST(list_sum(list_transform(range(0, p.blocks), lambda i:
         greatest(0, least(l.stop, ((i + 1) * p.words) // p.blocks) - greatest(l.stop - l.size, (i * p.words) // p.blocks))
         * (p.quota // p.blocks + CASE WHEN (i * {STEP} + p.turn) % p.blocks < p.quota % p.blocks THEN 1 ELSE 0 END)
       )) AS BIGINT) END AS taken
FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard
"""
