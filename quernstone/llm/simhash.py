"""SimHash fingerprints of word shingles, linked through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .base import attach, bounded_batches, staged
from .components import connected_components

#: Words of a shingle, seed of its XXH64, and most differing bits of a link.
SHINGLE_WORDS, SEED, LINK_BITS = 4, 42, 4
#: Smaller buckets are compared pair by pair at once.
SMALL_BUCKET = 16
#: Rows of a bucket that one task compares; more are split into pairs of blocks.
BUCKET_ROWS = 4_096


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words; of all words if there are fewer.

    Words are runs of bytes other than space and U+0009 to U+000D, with A-Z in
    lower case, joined by single spaces.  No words, no hashes.
    """
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes))))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a signed integer; null text is empty."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py() or "", words)) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array(_signed(np.array(found, dtype=np.uint64)))], names=["id", "fp"]
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join what links of at most ``bits`` bits join, one fewer than nodes each."""
    values = np.unique(fps)
    left = values.view(np.uint64)
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = np.bitwise_count(left ^ node) <= bits
            if near.any():
                found = left[near]
                edges += [(int(_signed(np.array([node]))[0]), x) for x in _signed(found).tolist()]
                frontier += list(found)
                left = left[~near]
    return edges


def _bucket_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b, key): links within buckets; b is null for rows of too large buckets."""

    def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fps), 20_000):
                part = fps[start : start + 20_000]
                at, key = golay.keys(part.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(part[at])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(emit_keys, "key bigint, fp bigint")
    shards = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(shards, "key").sortWithinPartitions("key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        too_large: int | None = None  # a bucket whose rows go on to be split

        def out(a, b, key):
            return pa.record_batch(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"]
            )

        def close(key: np.ndarray, fp: np.ndarray) -> list[pa.RecordBatch]:
            """Links of whole buckets."""
            done: list[pa.RecordBatch] = []
            if not len(key):
                return done
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            # what is left of a bucket that was passed on follows its other rows
            split = (sizes > BUCKET_ROWS) | (key[starts] == (-1 if too_large is None else too_large))
            little = (sizes <= SMALL_BUCKET) & ~split
            small = np.repeat(little, sizes)
            k, f = key[small], fp[small]
            u = f.view(np.uint64)
            firsts, seconds = [], []
            for gap in range(1, SMALL_BUCKET):
                same = np.flatnonzero(k[gap:] == k[:-gap]) if len(k) > gap else np.empty(0, dtype=np.int64)
                if not len(same):
                    break
                same = same[np.bitwise_count(u[same] ^ u[same + gap]) <= bits]
                firsts.append(f[same])
                seconds.append(f[same + gap])
            if firsts:
                pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(seconds)]), axis=1)
                done.append(out(pairs[0], pairs[1], np.zeros(pairs.shape[1], dtype=np.int64)))
            for at, size, pass_on in zip(starts[~little].tolist(), sizes[~little].tolist(), split[~little].tolist()):
                own = fp[at : at + size]
                if pass_on:
                    done.append(out(own, [None] * size, key[at : at + size]))
                elif edges := _forest(own, bits):
                    done.append(out([a for a, _ in edges], [b for _, b in edges], [0] * len(edges)))
            return done

        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
            yield from close(held_key[:cut], held[:cut])
            held_key, held = held_key[cut:], held[cut:]
            if len(held) > BUCKET_ROWS or (len(held) and held_key[0] == too_large):
                # an open bucket that is too large already: pass its rows on
                too_large = int(held_key[0])
                yield out(held, [None] * len(held), held_key)
                held_key, held = held_key[:0], held[:0]
        if len(held) and held_key[0] == too_large:
            yield out(held, [None] * len(held), held_key)
        else:
            yield from close(held_key, held)

    return dealt.mapInArrow(link, "a bigint, b bigint, key bigint")


def _split_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) within large buckets (key, fp), each pair of blocks on its own."""
    half = BUCKET_ROWS // 2
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks"))
    placed = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )

    def join_blocks(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group["fp"].to_numpy(), bits), columns=["a", "b"]).astype("int64")

    return met.groupBy("key", "i", "j").applyInPandas(join_blocks, "a bigint, b bigint")


def link_fingerprints(distinct: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """(a, b) edges whose components are those of all links of at most ``bits`` bits."""
    if not 0 <= bits <= golay.MOST_BITS:
        raise ValueError(f"the keys find links of at most {golay.MOST_BITS} bits")
    found = staged(_bucket_links(distinct, bits), "simhash-links")
    large = found.filter("b is null").select("key", F.col("a").alias("fp"))
    edges = found.filter("b is not null").select("a", "b")
    if not large.isEmpty():
        edges = edges.unionByName(_split_buckets(large, bits))
    return edges


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    bits: int = LINK_BITS,
) -> DataFrame:
    """``id_col``, fingerprint, component_id for every row of ``docs``.

    ``component_id`` is the smallest id that links of at most ``bits`` bits
    reach.  Null, empty and white-space texts have fingerprint zero and are
    linked like any other; repeated rows share their fingerprint; null ids are
    never a component's id unless it has no other.  No rows give no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = staged(distinct, "distinct-fingerprints")
    roots = connected_components(link_fingerprints(distinct, bits))
    rooted = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id", "copies")
    return attach(prints, labels, ["fp"], "copies").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
