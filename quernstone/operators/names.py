"""Many names in many texts: a join by the first words of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a name that it is looked up by, if it has so many.
HEAD = 3
WORD = "[\\p{L}\\p{N}\\p{M}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def names_in_texts(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """(key, at, words, name): names found in texts, the leftmost first and of those the longest; none overlap.

    A name stands for its words (letters, marks and digits), compared as they
    are, so it is found at word bounds only; ``at`` is the number of its first
    word from 0.  Names are looked up by their first words, up to HEAD, so the
    work grows with the texts and with what is found, not with the number of
    names, of which any number will do.  Names of the same words count once, as the
    smallest; empty and NULL ones and texts have nothing.  ``key`` is unique.
    """
    parts = names.select(F.col(name).alias("name"), words_of(F.col(name)).alias("w")).filter("size(w) > 0")
    parts = parts.groupBy("w").agg(F.min("name").alias("name"))
    head = F.concat_ws(" ", F.slice("w", 1, HEAD))
    known = parts.select(head.alias("head"), F.size("w").alias("n"), F.concat_ws(" ", "w").alias("whole"), "name")
    longest = known.agg(F.max("n")).first()[0] or 0
    if not longest:
        return texts.select(key, F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit("").alias("name")).limit(0)
    split = texts.select(key, words_of(F.col(text)).alias("w"))
    # each place with the words from it on, no more than a name can have
    ahead = F.transform("w", lambda _, i: F.slice("w", i + 1, F.lit(longest)))
    here = split.select(key, F.posexplode(ahead).alias("at", "w"))
    # a place is looked up by its first word, two words, three words
    sizes = F.sequence(F.lit(1), F.least(F.lit(min(HEAD, longest)), F.size("w")))
    tried = here.select(key, "at", "w", F.explode(sizes).alias("k"))
    tried = tried.withColumn("head", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))))
    # fewer words than HEAD are a whole name, or none
    fits = (F.col("n") == F.col("k")) | ((F.col("k") == HEAD) & (F.col("n") > HEAD) & (F.size("w") >= F.col("n")) & (F.concat_ws(" ", F.slice("w", F.lit(1), F.col("n"))) == F.col("whole")))
    found = tried.join(known, "head").filter(fits)
    best = found.groupBy(key, "at").agg(F.max(F.struct("n", "name")).alias("m")).select(key, "at", "m.n", "m.name")
    # of a text's finds, in order, those that begin after the one before has ended
    listed = F.array_sort(F.collect_list(F.struct("at", "n", "name")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int,name:string>>").alias("kept"))
    taken = F.aggregate(
        "listed", none, lambda acc, f: F.when(f["at"] >= acc["end"], F.struct((f["at"] + f["n"]).alias("end"), F.array_append(acc["kept"], f).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    kept = best.groupBy(key).agg(listed.alias("listed")).select(key, F.explode(taken).alias("f"))
    return kept.select(key, F.col("f.at").alias("at"), F.col("f.n").alias("words"), F.col("f.name").alias("name"))
