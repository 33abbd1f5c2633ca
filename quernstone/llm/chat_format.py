"""Multi-party perspective rotation of dialogues (DataFrame functions only).

A dialogue is rendered once for each of its speakers: that speaker's turns as
the assistant's, everyone else's as those of users with names, system turns as
they are.  Masks are the character ranges that count in training: what the
assistant says, with the mark that ends it.

A rendering of any length comes in parts of at most ``PART_TURNS`` turns, which
follow each other: every speaker of the dialogue has every part, and the parts in
order are the whole rendering.  Turns are numbered without gathering a dialogue:
rows are sorted by range over dialogue and turn, so that a long dialogue spans
several tasks, and each task's count of a dialogue is added up over the tasks
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import staged

#: Turns of a part at most.
PART_TURNS = 128
#: Parts of a dialogue that meet its speakers in one task.
SLICE = 64
#: Marks around a turn; inside texts their beginning is broken up by a space.
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NOBODY = "unknown"
#: What stands for characters of names that marks or lines are made of; the sign itself first.
ESCAPED = {"%25": "%", "%0A": "\n", "%3C": "<", "%3E": ">", "%7C": "|"}


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, speaker, text) with ``nth``, from 0 in each dialogue.

    The order is by turn, then speaker, then text; nulls first.  Equal rows
    follow each other.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "speaker", "text")]
    shards = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    placed = staged(
        placed.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "turns"
    )
    stretches = placed.groupBy("conv", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # a dialogue has at most one row here for each task that it spans
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.alias("t").join(
        stretches.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")) & (F.col("t.task") == F.col("s.task"))
    ).select("t.conv", "t.turn", "t.speaker", "t.text", (F.col("earlier") + F.col("place") - F.col("first")).alias("nth"))


def _name(speaker: Column) -> Column:
    """The name without line ends or marks; different names stay different."""
    for code, char in ESCAPED.items():
        speaker = F.replace(speaker, F.lit(char), F.lit(code))
    return speaker


def _rendered(turn: Column, perspective: Column) -> Column:
    """struct(head, body, own): a turn's opening, what is said with its end, and whether it counts."""
    speaker = turn["speaker"]
    own = speaker == perspective
    head = F.when(speaker == SYSTEM, F.lit(f"{BEGIN}system\n")).when(own, F.lit(f"{BEGIN}assistant\n")).otherwise(
        F.concat(F.lit(f"{BEGIN}user name="), _name(speaker), F.lit("\n"))
    )
    body = F.concat(F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit(END))
    return F.struct(head.alias("head"), body.alias("body"), (own & (speaker != SYSTEM)).alias("own"))


def _seen_by(parts: DataFrame, placed: DataFrame, part_turns: int) -> DataFrame:
    """``parts`` (conv, part, turns) once for each ``speaker`` of their dialogues.

    A long dialogue's speakers go to each slice of ``SLICE`` parts, so that its
    parts do not meet in one task.
    """
    lengths = placed.groupBy("conv").agg(F.floor(F.max("nth") / (part_turns * SLICE)).alias("slices"))
    speakers = placed.filter(F.col("speaker") != SYSTEM).select("conv", "speaker").distinct()
    spread = speakers.alias("s").join(lengths.alias("l"), F.col("s.conv").eqNullSafe(F.col("l.conv"))).select(
        "s.conv", "speaker", F.explode(F.sequence(F.lit(0), F.col("slices"))).alias("slice")
    )
    sliced = parts.withColumn("slice", F.floor(F.col("part") / SLICE))
    same = F.col("p.conv").eqNullSafe(F.col("s.conv")) & (F.col("p.slice") == F.col("s.slice"))
    return sliced.alias("p").join(spread.alias("s"), same).select("p.conv", "part", "turns", "s.speaker")


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row for each dialogue, speaker in it, and part of the rendering.

    Returns ``conv_col``, speaker, part (from 0), first_turn (turns of the dialogue
    before the part), n_turns, rendered, masks (array of start, end in characters
    of the part, end exclusive).  A rendering is its parts in order, without
    anything between them; a speaker who says nothing in a part has no masks
    there.  ``system`` is no speaker, but its turns are in every rendering.  A null
    or empty speaker is ``unknown``, null text is empty, a null conversation is
    one of its own.  Equal turns are all kept.  Marks inside texts are broken up
    and escaped in names.  A dialogue of ``system`` alone gives no rows; so does
    an empty table.
    """
    clean = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.nullif(F.col(speaker_col).cast("string"), F.lit("")), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    placed = numbered(clean)
    parts = (
        placed.groupBy("conv", F.floor(F.col("nth") / part_turns).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("nth", "speaker", "text"))).alias("turns"))  # at most part_turns
    )
    views = _seen_by(parts, placed, part_turns)
    rendered = views.withColumn("pieces", F.transform("turns", lambda t: _rendered(t, F.col("speaker"))))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        stop = start + F.length(piece["body"])
        span = F.when(piece["own"], F.array(F.struct(start.alias("start"), stop.alias("end")))).otherwise(
            F.array().cast("array<struct<start:int,end:int>>")
        )
        return F.struct((stop + 1).alias("at"), F.concat(state["spans"], span).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return rendered.select(
        F.col("conv").alias(conv_col),
        "speaker",
        F.col("part").cast("int").alias("part"),
        F.col("turns")[0]["nth"].alias("first_turn"),
        F.size("turns").alias("n_turns"),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("rendered"),
        F.aggregate("pieces", none, add)["spans"].alias("masks"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """The masks as text and the rendering as its length and SHA-256, for comparison."""
    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rows.withColumns(
        {
            "n_chars": F.length("rendered").cast("bigint"),
            "rendered_sha256": F.sha2("rendered", 256),
            "spans": spans,
        }
    ).drop("rendered", "masks")


def _name_sql(speaker: str) -> str:
    for code, char in ESCAPED.items():
        speaker = f"replace({speaker}, {'chr(10)' if char == chr(10) else repr(char)}, '{code}')"
    return speaker


OP4_SQL = f"""
WITH clean AS (
  SELECT conv_id AS conv, turn, coalesce(nullif(role, ''), '{NOBODY}') AS speaker, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, speaker, text) - 1 AS nth FROM clean
), views AS (
  SELECT DISTINCT conv, speaker AS perspective FROM clean WHERE speaker <> '{SYSTEM}'
), pieces AS (
  SELECT t.conv, t.nth // {PART_TURNS} AS part, v.perspective, t.nth,
    CASE WHEN t.speaker = '{SYSTEM}' THEN '{BEGIN}system' || chr(10) WHEN t.speaker = v.perspective THEN '{BEGIN}assistant' || chr(10)
         ELSE '{BEGIN}user name=' || {_name_sql("t.speaker")} || chr(10) END AS head,
    replace(t.text, '<|', '< |') || '{END}' AS body, t.speaker = v.perspective AS own
  FROM numbered t JOIN views v ON t.conv IS NOT DISTINCT FROM v.conv
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv, part, perspective ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM pieces
)
SELECT conv AS conv_id, perspective AS speaker, CAST(part AS INTEGER) AS part, min(nth) AS first_turn, CAST(count(*) AS INTEGER) AS n_turns,
  length(string_agg(head || body, chr(10) ORDER BY nth) || chr(10)) AS n_chars,
  sha256(string_agg(head || body, chr(10) ORDER BY nth) || chr(10)) AS rendered_sha256,
  coalesce(string_agg(CAST(begins + length(head) AS VARCHAR) || '-' || CAST(begins + length(head) + length(body) AS VARCHAR), ',' ORDER BY nth) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY 1, 2, 3
"""
