"""Identity, keyed unions, dedup and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import record_id
from ..functions.text import jaccard, message_fingerprint, word_set
from ..scratch import written


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stable_id(parts: list[Column], size: int = 32) -> Column:
    """SHA-256 of the lower-cased, trimmed parts joined by bars; NULL is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.lower(F.trim(_text(p))) for p in parts)), 256), 1, size)


def content_id(df: DataFrame, volatile: set[str] = frozenset(), size: int = 32) -> Column:
    """SHA-256 of the JSON of all columns but volatile ones, names in order at every depth."""
    return record_id(df, tuple(volatile), size)


def incident_id(parts: list[Column]) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *map(_text, parts))), 1, 16)


def entity_key(name: Column, age: Column, year: Column) -> Column:
    """NULL without a name; ``name`` is normalised already."""
    named = F.length(F.trim(F.coalesce(name, F.lit("")))) > 0
    return F.when(named, F.substring(F.sha2(F.concat_ws("|", _text(name), _text(age), _text(year)), 256), 1, 32))


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that a frame lacks are NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def last_wins(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """One row per key: that of the last frame that has it, there the largest ``order``."""
    ranked = [f.withColumn("__priority", F.lit(i)) for i, f in enumerate(frames)]
    joined = union_all(*ranked)
    rest = [c for c in joined.columns if c not in (*keys, "__priority")]
    best = F.max_by(F.struct(*rest), F.struct("__priority", order)).alias("__row")
    return joined.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace existing ones with their key."""
    return union_all(existing.join(fresh.select(*keys).distinct(), keys, "left_anti"), fresh)


def insert_new(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows win over fresh ones with their key."""
    return union_all(existing, fresh.join(existing.select(*keys).distinct(), keys, "left_anti"))


def archive(existing: DataFrame, fresh: DataFrame, key: Column, order: str) -> DataFrame:
    """Append rows with a new key, the first of each; rows without key are left out."""
    keyed = fresh.withColumn("__key", key).filter("__key is not null")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(order))
    first = keyed.withColumn("__n", nth).filter("__n = 1").drop("__n")
    known = existing.withColumn("__key", key).select("__key").distinct()
    return union_all(existing, first.join(known, "__key", "left_anti").drop("__key"))


def dedupe_merging(df: DataFrame, key: str, order: str, arrays: list[str]) -> DataFrame:
    """The first row of each key, with the arrays of all its rows merged without repeats."""
    rest = [c for c in df.columns if c not in (key, *arrays)]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("__row")
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in arrays]
    return df.groupBy(key).agg(first, *merged).select(key, *(F.col(f"__row.{c}").alias(c) for c in rest), *arrays)


def collisions(df: DataFrame, key: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), (F.count(key) - F.countDistinct(key)).alias("collisions")
    )


def resolve(df: DataFrame, key: str, fields: list[str], created: str, id_col: str, attributions: str | None = None) -> DataFrame:
    """Keeper of each key: the most complete row, then the earliest, then the smallest id.

    ``attributions`` names a column of datasets; the keeper gets those of all its rows, each once.
    """
    complete = sum((F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1).otherwise(0) for f in fields), F.lit(0))
    scored = df.filter(F.col(key).isNotNull()).withColumn("__score", complete)
    best = F.min_by(F.struct(id_col, "__score"), F.struct(-F.col("__score"), F.col(created), F.col(id_col))).alias("__b")
    merged = [F.array_sort(F.collect_set(attributions)).alias(attributions)] if attributions else []
    return scored.groupBy(key).agg(best, F.count(F.lit(1)).alias("merged"), *merged).select(
        key, F.col(f"__b.{id_col}").alias("keeper"), F.col("__b.__score").alias("completeness"), "merged", *([attributions] if attributions else [])
    )


#: Messages of a block of ``near_duplicates``.
BLOCK = 1000


def _blocks(messages: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """(key, s, block, pos): blocks of messages in order of time and key, each also with the ``most`` before it.

    Only keys and times are sorted, over all tasks; a place in the order is that in
    its range and the rows of the ranges before.
    """
    at = F.unix_seconds(F.col(time).cast("timestamp")).alias("s")
    rows = messages.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, F.col(time).alias("__t"), at)
    ranges = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 2, "__t", key).withColumn("__part", F.spark_partition_id())
    ranges = written(ranges, "order")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__t", key)) - 1
    placed = ranges.withColumn("__nth", nth).join(starts, "__part").withColumn("pos", F.col("__start") + F.col("__nth"))
    size = max(BLOCK, most)
    block = F.floor(F.col("pos") / size)
    both = F.when(F.col("pos") % size >= size - most, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.select(key, "s", "pos", F.explode(both).alias("block"))


def near_duplicates(messages: DataFrame, key: str, text: str, time: str, seconds: int = 1800, most: int = 50, least_chars: int = 15, threshold: float = 0.6) -> DataFrame:
    """(key, other, similarity) of messages whose words overlap one of the newest before them.

    Only the ``most`` newest within ``seconds`` before a message are compared,
    as the definition has it.  Messages of fewer characters never match.  Words, as
    64-bit hashes, go to the block of their message and at most one more, once each.
    """
    import numpy as np
    import pandas as pd

    size = max(BLOCK, most)
    base = messages.select(F.col(key), message_fingerprint(F.col(text)).alias("__f")).filter(F.length("__f") >= least_chars)
    base = base.select(key, F.transform(word_set(F.col("__f")), lambda w: F.xxhash64(w)).alias("__w"))
    dealt = _blocks(messages, key, time, most).join(base, key, "left")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        words = [np.zeros(0, np.int64) if w is None else np.asarray(w, np.int64) for w in rows["__w"]]
        n = np.array([len(w) for w in words])
        ends = np.cumsum(n)
        codes, names = pd.factorize(np.concatenate(words))
        marked = np.zeros(len(names) + 1, bool)
        s, keys = rows["s"].to_numpy(), rows[key].to_numpy()
        own = (rows["pos"] // size == rows["block"]).to_numpy()
        found = []
        for i in np.flatnonzero(own & (n > 0)):
            low = max(0, i - most)
            near = (s[i] - s[low:i] <= seconds) & (n[low:i] > 0)
            near &= np.minimum(n[low:i], n[i]) > threshold * np.maximum(n[low:i], n[i]) - 1e-4
            if not near.any():
                continue
            first = low + int(near.argmax())
            begin = ends[first] - n[first]
            mine = codes[ends[i] - n[i] : ends[i]]
            marked[mine] = True
            sums = np.append(0, np.cumsum(marked[codes[begin : ends[i - 1]]]))
            marked[mine] = False
            both = sums[ends[first:i] - begin] - sums[ends[first:i] - n[first:i] - begin]
            # rounded as SQL rounds doubles
            similar = np.floor(both / (n[i] + n[first:i] - both).clip(1) * 1e4 + 0.5) / 1e4
            for j in np.flatnonzero(near[first - low :] & (similar > threshold)):
                found.append((keys[i], keys[first + j], similar[j]))
        return pd.DataFrame(found, columns=[key, "other", "similarity"])

    kind = messages.schema[key].dataType.simpleString()
    return dealt.groupBy("block").applyInPandas(compared, f"`{key}` {kind}, other {kind}, similarity double")


def similar_pairs(pairs: DataFrame, messages: DataFrame, key: str, text: str, least_chars: int = 15, threshold: float = 0.6) -> DataFrame:
    """(key, other, similarity) of those of ``pairs`` (key, other) whose messages' words overlap by more than ``threshold``.

    Pairs carry sizes at first, and words, as 64-bit hashes, only where these allow
    for the similarity.  Words are made once, as a scratch table.
    """
    prints = message_fingerprint(F.col(text))
    words = F.transform(word_set(F.col("__f")), lambda w: F.xxhash64(w))
    base = messages.select(F.col(key), prints.alias("__f")).filter(F.length("__f") >= least_chars).select(key, words.alias("__w"))
    base = written(base, "words")
    sizes = base.select(key, F.size("__w").alias("__n"))
    other = lambda df: df.select(*(F.col(c).alias("other" if c == key else f"r_{c}") for c in df.columns))
    probed = pairs.join(sizes, key).join(other(sizes), "other")
    able = F.least("__n", "r___n") > threshold * F.greatest("__n", "r___n") - 1e-4
    probed = probed.filter(able).select(key, "other").join(base, key).join(other(base), "other")
    similar = F.round(jaccard(F.col("__w"), F.col("r___w")), 4)
    return probed.withColumn("similarity", similar).filter(F.col("similarity") > threshold).select(key, "other", "similarity")


def coverage(used: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    """Names in use that a registry lacks: whole, then by ``;``, then by ``,``."""
    known = registry.select(F.lower(F.trim(name)).alias("__k")).distinct()
    whole = used.select(F.col(name)).distinct().withColumn("__k", F.lower(F.trim(name)))
    left = whole.join(known, "__k", "left_anti")
    for mark in (";", ","):
        parts = left.select(name, F.explode(F.split("__k", mark)).alias("__p")).select(name, F.trim("__p").alias("__k"))
        unknown = parts.filter("__k <> ''").join(known, "__k", "left_anti").select(name).distinct()
        left = left.join(unknown, name, "left_semi")
    return left.select(name)


def greedy_route_dedup(rows: DataFrame, route: str, least_m: float = 200.0) -> DataFrame:
    """Keeps closed places first, then the nearest; drops one with a kept name or nearby.

    The choice depends on its order, so each route's few places are one group.
    """
    import numpy as np
    import pandas as pd

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(__c=(group["status"] != "closed").astype(int)).sort_values(["__c", "metres", "name"]).drop(columns="__c")
        lat, lon, names = group["lat"].to_numpy(), group["lon"].to_numpy(), group["name"].to_numpy()
        free = np.ones(len(group), dtype=bool)
        kept = []
        for i in range(len(group)):
            if free[i]:
                kept.append(i)
                y, x = (lat - lat[i]) * 111_320.0, (lon - lon[i]) * 111_320.0 * np.cos(np.radians(lat))
                free &= (np.hypot(x, y) > least_m) & (names != names[i])
        return group.iloc[kept]

    return rows.groupBy(route).applyInPandas(keep, rows.schema)
