"""Ordered rules over texts, message parsing, and text search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """``include`` and ``exclude`` are patterns over the lower-cased text."""

    label: str
    severity: str
    include: str
    exclude: str | None = None


def classify(text: Column, rules: list[Rule], noise: str | None = None) -> Column:
    """struct(label, severity) of the first rule that holds; NULL for noise or none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kind = "struct<label:string,severity:string>"
    found = F.lit(None).cast(kind)
    for rule in reversed(rules):
        holds = low.rlike(rule.include)
        if rule.exclude:
            holds = holds & ~low.rlike(rule.exclude)
        found = F.when(holds, F.struct(F.lit(rule.label).alias("label"), F.lit(rule.severity).alias("severity"))).otherwise(found)
    return F.when(low.rlike(noise), F.lit(None).cast(kind)).otherwise(found) if noise else found


def mapped(value: Column, synonyms: dict[str, str]) -> Column:
    """Known synonyms become their name; anything else stays."""
    pairs = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(value))), value)


def parse_statuses(messages: DataFrame, key: str, text: str, statuses: dict[str, str], directions: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """(key, name, status, direction) from lines like ``name: status``; one per name and direction.

    A line may have several statuses, parted by commas, semicolons or dashes.  The
    last line counts.  ``known`` (name) keeps names of a knowledge base only.
    Lines without a colon, emojis and folded words are for ``messages``.
    """
    lines = messages.select(key, F.posexplode(F.split(F.lower(text), "\n")).alias("line_no", "line"))

    def first_of(words: dict[str, str], c: Column) -> Column:
        found = F.lit(None).cast("string")
        for word, name in reversed(list(words.items())):
            found = F.when(c.contains(word), name).otherwise(found)
        return found

    name = F.regexp_replace(F.trim(F.substring_index("line", ":", 1)), "\\s+", "_")
    said = F.split(F.expr("substr(line, instr(line, ':') + 1)"), "[,;،–—]|(?:^| )-(?= |$)")
    named = lines.filter(F.contains("line", F.lit(":"))).select(key, "line_no", name.alias("name"), F.explode(said).alias("said"))
    parsed = named.select(
        key, "line_no", "name", first_of(statuses, F.col("said")).alias("status"),
        F.coalesce(first_of(directions, F.col("said")), F.lit("both")).alias("direction"),
    ).filter("status is not null and name <> ''")
    if known is not None:
        parsed = parsed.join(known.select("name").distinct(), "name", "left_semi")
    last = F.max_by("status", "line_no").alias("status")
    return parsed.groupBy(key, "name", "direction").agg(last)


def dominant_words(messages: DataFrame, key: str, text: str, label: str, least: int, share: float = 0.8) -> DataFrame:
    """Words seen at least ``least`` times whose most frequent label has that share."""
    words = messages.select(label, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word", label).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("word").agg(
        F.sum("n").cast("bigint").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))).alias("top")
    )
    return total.filter((F.col("total") >= least) & (-F.col("top.n") / F.col("total") >= share)).select(
        "word", "total", F.col("top.label").alias("label"), F.round(-F.col("top.n") / F.col("total"), 4).alias("share")
    )


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (key, term, tf)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def search(docs: DataFrame, key: str, text: str, query: str, fuzzy: float = 0.2, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best documents by BM25 over equal, prefixed and similar terms; ties by key.

    A term counts fully if equal, 0.75 as a prefix, 0.5 within the edit distance
    round(fuzzy * length).  Words that are not asked for are dropped where they
    are read; only hits, with the length of their text, are counted over a shuffle.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    read = docs.select(key, words.alias("__words"))
    stats = read.filter(F.size("__words") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("__words")).alias("mean"))
    asked = sorted(set(query.lower().split()))
    weight = F.lit(0.0)
    for word in asked:
        edits = round(fuzzy * len(word))
        close = F.when(F.col("term") == word, 1.0).when(F.col("term").startswith(word), 0.75)
        if edits:
            alike = F.length("term").between(len(word) - edits, len(word) + edits)
            close = close.when(alike & (F.levenshtein(F.col("term"), F.lit(word), edits) >= 0), 0.5)
        weight = F.greatest(weight, close.otherwise(0.0))
    found = read.select(key, F.size("__words").alias("length"), F.explode("__words").alias("term")).withColumn("weight", weight)
    hits = found.filter("weight > 0").groupBy(key, "term", "length", "weight").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return (
        scored.groupBy(key).agg(F.round(F.sum(F.col("weight") * idf * part), 4).alias("score"))
        .orderBy(F.desc("score"), key).limit(min(limit, 100))
    )


def longest_matches(text: Column, names: list[str]) -> Column:
    """Names found as whole words, longest first, without overlaps; a pandas function."""
    import re

    import pandas as pd

    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)")

    def find(column):
        return column.map(lambda t: None if t is None else pattern.findall(t))

    # annotations here would be strings, which Spark cannot resolve inside a function
    find.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, T.ArrayType(T.StringType()))(text)


def latest_in_group(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__n", nth).filter("__n = 1").drop("__n")
