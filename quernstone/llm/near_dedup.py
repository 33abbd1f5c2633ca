"""SimHash near-dedup of texts by the similarity of their word shingles.

A 64-bit SimHash of a whole text finds texts that differ in a few bits, which at
a similarity of 0.8 is the exception.  So a text gets several fingerprints, each
the SimHash of a small min-wise sample of its shingles: two texts whose samples
agree have equal fingerprints, which at a similarity s happens with probability
s**3 for samples of three.  Fingerprints are hashed fuzzily: each of three
segments is decoded to the index of its nearest Golay codeword, and texts that
share all three indices of one fingerprint are candidates.  Candidates are
verified on their whole shingle sets.

Short texts are found without a miss: with a similarity of 0.8, the shingles that
are least by one order common to all texts agree in at least three of the first
n - ceil(0.8 n) + 3, so every triple of these is sampled instead.

Buckets of candidates with few texts give pairs.  In larger ones pairs within a
cluster need no comparison once the cluster is known.  All texts of a bucket are
compared with one of them, its leader.  As one minus the similarity is a metric,
a text that is far from the leader has no link to those near it; so only texts at
a middling distance meet them, and the others go on with a leader of their own.
What is left when that stops to help is compared block by block.  No task
compares, or emits, all pairs of a large group of copies, and no candidate is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .base import attach, bounded_batches, staged
from .components import connected_components
from .exact_dedup import digest_of, one_of_each
from .simhash import majority, shingle_hashes

#: Words of a shingle, and least similarity (Jaccard) of near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of a text, and shingles that each samples.  At a similarity of
#: 0.8 a pair is missed with probability (1 - 0.8**3)**12 = 0.0002.
ROUNDS, SAMPLED = 12, 3
#: Two texts of up to so many shingles are found without a miss.
SHORT = 24
#: Buckets of up to so many texts give pairs at once.
PAIR_BUCKET = 24
#: Texts of a block when a larger bucket is split, and bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 256, 16_000_000
#: Larger shares of all candidates than one in so many make a bucket hot.
HOT_SHARE = 500
#: Texts that meet one copy of their leader's shingles.
LED = 1_024
#: A round of leaders that takes a smaller share of the texts is the last.
LEAST_TAKEN = 0.2

_mixers = np.random.default_rng(7).integers(1, 1 << 63, size=(64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(hashes: np.ndarray, round_: int) -> np.ndarray:
    """Another hash of each hash: two rounds of multiply and shift."""
    a, b = _mixers[round_]
    x = (hashes ^ (hashes >> np.uint64(29))) * a
    x = (x ^ (x >> np.uint64(32))) * b
    return x ^ (x >> np.uint64(31))


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """SimHashes of three shingles each: the bits that are set in two of them."""
    return (a & b) | (a & c) | (b & c)


def sketches(hashes: np.ndarray, rounds: int = ROUNDS, sampled: int = SAMPLED) -> np.ndarray:
    """A SimHash of the ``sampled`` least shingles by each of ``rounds`` hashes."""
    out = np.zeros(rounds, dtype=np.uint64)
    for r in range(rounds):
        mixed = _mixed(hashes, r)
        least = np.partition(mixed, sampled - 1)[:sampled] if len(mixed) > sampled else mixed
        out[r] = _three(*least) if len(least) == 3 else majority(least)
    return out


@cache
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3).T


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares with any set that is similar, at least."""
    return ceil(similarity * n - 1e-9)


def prefix_prints(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """SimHashes of the triples of a short text's least shingles; hashes are sorted.

    Two similar texts share at least three of these shingles; those of fewer
    than three shingles are similar to equal ones only and need none.
    """
    n = len(hashes)
    if n < 3:
        return np.empty(0, dtype=np.uint64)
    return _three(*hashes[_triples(min(n, n - least_shared(n, similarity) + 3))])


def bucket_keys(prints: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Tag and nearest codewords of the three segments of each fingerprint."""
    key = tags.astype(np.int64) << 36
    for i, (at, size) in enumerate(golay.SEGMENTS):
        segment = ((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)
        key |= golay.codewords(segment)[:, 0] << (12 * i)
    return key


def keys_of(hashes: np.ndarray, similarity: float, rounds: int) -> np.ndarray:
    """The bucket keys of a text, from its different shingles' sorted hashes.

    Short texts have keys of prefixes.  Those that may be similar to longer ones
    have keys of samples, too, and longer ones these alone.  At a similarity of
    2/3 or less two short texts may share fewer than three shingles, and all
    have keys of samples.
    """
    parts = [np.empty(0, dtype=np.int64)]
    if (short := 3 * similarity > 2) and len(hashes) <= SHORT:
        prints = prefix_prints(hashes, similarity)
        parts.append(bucket_keys(prints, np.full(len(prints), rounds)))
    if not short or len(hashes) >= least_shared(SHORT + 1, similarity):
        parts.append(bucket_keys(sketches(hashes, rounds), np.arange(rounds)))
    return np.unique(np.concatenate(parts))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    return jaccard(a, b) >= least


def near_leader(similarity: float) -> float:
    """Texts less similar to a leader than this are not similar to any text that is similar to it."""
    return 1.0 - 2.0 * (1.0 - similarity) - 1e-9


def _set_of(text: str, words: int) -> np.ndarray:
    """The text's shingles as sorted 32-bit hashes."""
    return np.unique(shingle_hashes(text, words).astype(np.uint32))


def clusters(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that join what all similar pairs would join.

    A text is compared with the members of each cluster until one is similar;
    only clusters that it does not belong to are gone through in full.
    """
    groups: list[list[int]] = []
    edges: list[tuple[int, int]] = []
    for i in range(len(ids)):
        joined: list[int] | None = None
        rest = []
        for group in groups:
            near = next((j for j in group if _similar(sets[i], sets[j], least)), None)
            if near is None:
                rest.append(group)
                continue
            edges.append((ids[i], ids[near]))
            joined = group if joined is None else joined + group
        groups = rest
        groups.append([*(joined or []), i])
    return edges


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), digest_of(F.col(text_col)).alias("sha")
    )


def _contents(rows: DataFrame, words: int, similarity: float, rounds: int) -> DataFrame:
    """(id, sha, c1, c2, keys): a 128-bit digest of the shingle set, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys = [], []
            for text in batch.column(1):
                found = np.unique(shingle_hashes(text.as_py() or "", words))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(keys_of(found, similarity, rounds))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            flat = np.concatenate([np.empty(0, dtype=np.int64), *keys])
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["id", "sha", "c1", "c2", "keys"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, sha binary, c1 bigint, c2 bigint, keys array<bigint>")


def _candidates(keyed: DataFrame) -> DataFrame:
    """(a, b, key): pairs of small buckets; the texts of larger ones with b null.

    Buckets with more than one in ``HOT_SHARE`` of all rows, of which there are
    fewer than that, are known from counts and not dealt out by key.  The rows
    of other large buckets pass through as they come, so a task holds no more of
    a bucket than a batch.
    """
    shards = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIR_BUCKET)
    hot = staged(counts.filter(F.col("n") * HOT_SHARE > keyed.count()).select("key").limit(HOT_SHARE), "near-hot")
    passed = keyed.join(F.broadcast(hot), "key").select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "key")
    rest = keyed.join(F.broadcast(hot), "key", "left_anti").select("key", "node")
    dealt = rest.repartition(shards, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held = np.empty(0, dtype=np.int64)
        passing: int | None = None

        def out(a, b, key) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

        def close(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            each = np.repeat(sizes, sizes)
            large = (each > PAIR_BUCKET) | (key == (passing if passing is not None else -1))
            if large.any():
                yield out(node[large], [None] * int(large.sum()), key[large])
            some = ~large & (each > 1)
            k, n = key[some], node[some]
            for gap in range(1, PAIR_BUCKET):
                same = np.flatnonzero(k[gap:] == k[:-gap]) if len(k) > gap else []
                if not len(same):
                    break
                yield out(n[same], n[same + gap], np.zeros(len(same), dtype=np.int64))

        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
            yield from close(held_key[:cut], held[:cut])
            held_key, held = held_key[cut:], held[cut:]
            if len(held) > PAIR_BUCKET:
                passing = int(held_key[0])
                yield from close(held_key, held)
                held_key, held = held_key[:0], held[:0]
        yield from close(held_key, held)

    return dealt.mapInArrow(run, "a bigint, b bigint, key bigint").unionByName(passed)


def _verified_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x.as_py(), dtype=np.uint32), np.frombuffer(y.as_py(), dtype=np.uint32), least)
                for x, y in zip(batch.column("sa"), batch.column("sb"))
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _led(active: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``active`` (key, node, bytes) with the similarity ``s`` of each text to its bucket's least node, ``leader``.

    ``s`` is NULL where there can be no link to a text that is near the leader.
    """
    heads = staged(active.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")), "near-heads")
    led = staged(attach(active, heads, ["key"], "n").drop("n"), "near-led")
    asked = led.filter("node <> leader").select("node", "leader").distinct()
    counts = asked.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / LED).cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "near-leaders")
    # a leader of many goes to several tasks, each with a part of those it leads
    salted = attach(asked, counts, ["leader"], "n").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    leaders = sets.select(F.col("node").alias("leader"), F.col("s").alias("sb")).join(counts, "leader")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("leader", "salt", "sb")
    met = salted.select("node", "leader", "salt").join(sets.withColumnRenamed("s", "sa"), "node").join(leaders, ["leader", "salt"])
    least = near_leader(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [
                jaccard(np.frombuffer(x.as_py(), dtype=np.uint32), np.frombuffer(y.as_py(), dtype=np.uint32))
                for x, y in zip(batch.column("sa"), batch.column("sb"))
            ]
            found = pa.record_batch([batch.column("node"), batch.column("leader"), pa.array(s, pa.float64())], names=["node", "leader", "s"])
            yield found.filter(pa.array([x >= least for x in s], pa.bool_()))

    close = met.select("node", "leader", "sa", "sb").mapInArrow(run, "node bigint, leader bigint, s double")
    alone = led.filter("node = leader").withColumn("s", F.lit(1.0))
    return staged(led.filter("node <> leader").join(close, ["node", "leader"], "left").unionByName(alone), "near-round")


def _block_counts(rows: DataFrame) -> DataFrame:
    """(key, blocks, n) of buckets of ``rows`` (key, node, bytes, ...)."""
    n, size = F.count(F.lit(1)), F.sum("bytes")
    blocks = F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int").alias("blocks")
    return staged(rows.groupBy("key").agg(blocks, n.alias("n")), "near-blocks")


def _block(blocks: Column | str = "blocks") -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _between(middling: DataFrame, near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges between texts at a middling distance of a leader and those near it, one pair of blocks a group.

    Those near a leader are linked already, so the first that is similar will do.
    """
    few = _block_counts(middling).withColumnsRenamed({"blocks": "few", "n": "n_few"})
    many = _block_counts(near).withColumnsRenamed({"blocks": "many", "n": "n_many"})
    counts = staged(few.join(many, "key"), "near-meetings")
    one = attach(middling, counts, ["key"], "n_few").select("key", _block("few").alias("i"), _each("many").alias("j"), "node", "s", F.lit(True).alias("asks"))
    two = attach(near, counts, ["key"], "n_many").select("key", _each("few").alias("i"), _block("many").alias("j"), "node", "s", F.lit(False).alias("asks"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, s, np.frombuffer(x, dtype=np.uint32), asks) for n, s, x, asks in zip(group["node"], group["s"], group["set"], group["asks"])]
        found = []
        for n, s, mine, asks in rows:
            if asks:
                # distances to the leader that differ by more than a link's are of no link
                able = (m for m, t, x, too in rows if not too and t - s <= 1.0 - similarity + 1e-9 and _similar(mine, x, similarity))
                if (m := next(able, None)) is not None:
                    found.append((n, m))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    both = one.unionByName(two).join(sets.withColumnRenamed("s", "set"), "node")
    return both.groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def _within(members: DataFrame, counts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges within buckets (key, node, bytes), one pair of blocks a group."""
    placed = attach(members, counts, ["key"], "n").withColumn("own", _block())
    met = placed.withColumn("other", _each("blocks")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        found = clusters(group["node"].tolist(), [np.frombuffer(s, dtype=np.uint32) for s in group["s"]], similarity)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return met.join(sets, "node").groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def _clustered(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges within large buckets (key, node) that join what all their links would join."""
    sized = staged(members.join(sets.select("node", F.octet_length("s").alias("bytes")), "node"), "near-members")
    counts = _block_counts(sized)
    small, large = counts.filter("blocks = 1"), counts.filter("blocks > 1")
    edges = _within(sized, small, sets, similarity)
    active = attach(sized, large, ["key"], "n").select("key", "node", "bytes")
    before = active.count()
    while before:
        round_ = _led(active, sets, similarity)
        near, middling = round_.filter(F.col("s") >= similarity), round_.filter(F.col("s") < similarity)
        edges = edges.unionByName(near.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
        if not middling.isEmpty():
            edges = edges.unionByName(_between(middling, near, sets, similarity))
        active = round_.filter(F.col("s").isNull() | (F.col("s") < similarity)).select("key", "node", "bytes")
        after = active.count()
        if after > (1.0 - LEAST_TAKEN) * before:
            return edges.unionByName(_within(active, _block_counts(active), sets, similarity))
        before = after
    return edges


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(id, sha, c1, c2) of every row; (c1, c2, copies, root, n_links) of every shingle set.

    Shingle sets are numbered, and the text of one is looked up by its digest, so
    ids take no part in this.
    """
    texts = _texts(docs, id_col, text_col)
    found = staged(_contents(texts, words, similarity, rounds), "near-contents")
    contents = staged(
        found.groupBy("c1", "c2")
        .agg(F.min("sha").alias("sha"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    candidates = staged(_candidates(contents.select(F.explode("keys").alias("key"), "node")), "near-candidates")
    pairs = candidates.filter("b is not null").select("a", "b").distinct()
    members = candidates.filter("b is null").select("key", F.col("a").alias("node"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    wanted = contents.select("node", "sha").join(wanted, "node")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set_of(t.as_py() or "", words).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "s"])

    chosen = texts.select("sha", "text").join(wanted, "sha").dropDuplicates(["node"]).select("node", "text")
    sets = staged(chosen.mapInArrow(to_sets, "node bigint, s binary"), "near-sets")
    edges = _verified_pairs(pairs, sets, similarity)
    if not members.isEmpty():
        edges = edges.unionByName(_clustered(members, sets, similarity))
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    roots = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    labelled = (
        contents.select("c1", "c2", "node", "copies")
        .join(roots.withColumnRenamed("a", "node"), "node", "left")
        .join(degree, "node", "left")
        .select("c1", "c2", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return found.select("id", "sha", "c1", "c2"), staged(labelled, "near-labels")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``id_col``, keep_id, kept, n_links for every row of ``docs``.

    Documents are near copies if the sets of their shingles of ``words`` words
    (of all words, if there are fewer) have a Jaccard similarity of at least
    ``similarity``; groups are what such links join.  The smallest id of a group
    stays, a null id only if the group has no other.  Texts without words, null
    among them, are one group.  Rows that repeat the id that stays are all
    ``kept``, unlike in ``drop_near_copies``.  No rows give no rows.
    """
    found, labelled = _labelled(docs, id_col, text_col, words, similarity, rounds)
    least = found.groupBy("c1", "c2").agg(F.min("id").alias("id"))
    keep = labelled.join(least, ["c1", "c2"]).groupBy("root").agg(F.min("id").alias("keep_id"))
    placed = labelled.join(keep, "root")
    return attach(found.select("id", "c1", "c2"), placed.drop("root"), ["c1", "c2"], "copies").select(
        F.col("id").alias(id_col), "keep_id", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "n_links"
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with one row of each group of near copies, one with the smallest id.

    Ids may repeat or be null; a null id stays only if the group has no other.
    """
    found, labelled = _labelled(docs, id_col, text_col, words, similarity, rounds)
    # combined before their shuffles: no group is a load for a task
    rows = found.groupBy("c1", "c2", "id", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha", "n"))
    least = rows.groupBy("c1", "c2").agg(first.alias("least"))
    best = least.join(labelled.select("c1", "c2", "root"), ["c1", "c2"]).groupBy("root").agg(F.min("least").alias("least"))
    chosen = best.select("least.id", "least.sha", "least.n")
    return one_of_each(docs, staged(chosen, "near-chosen"), id_col, text_col)
