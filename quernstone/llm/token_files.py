"""Token-id files: documents in id order as independently decodable rANS blocks.

A file set is a folder with three Parquet parts, written and read by Spark, so
that any store that Spark reaches will do:

* ``frequencies``: the shared table (symbol, freq, bits);
* ``blocks``: one row for each block: its documents, their lengths, the coded
  words, checkpoints and a checksum;
* ``index``: the number of ids before each block.

Documents are dealt to shards by ranges of their id and a block never crosses a
document's end, unless one document alone is larger than a block should be.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from ..scratch import scratch_path
from .base import bounded_batches, staged
from .piece_table import JoinedEncoder, PieceTable, slices
from .token_counts import _load_json

#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 19
#: Id that ends each document.
END_ID = 0


@cache
def _encoder(path: str) -> PieceTable:
    """Ids of text columns, kept by the worker."""
    tokenizer, added = _load_json(path)
    kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    return PieceTable(JoinedEncoder(tokenizer, added, kind), kind, added)


def _tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, block_ids: int, end_id: int) -> DataFrame:
    """Blocks of plain ids, in id order over (shard, block)."""
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(tokenizer_path)
        end = np.array([end_id], dtype=table.kind).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(p) // table.kind.itemsize for p in parts]
            return pa.record_batch(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([b"".join(parts)], pa.binary()),
                ],
                names=["shard", "block", "n", "doc_ids", "lengths", "ids"],
            )

        size = 0
        for batch in batches:
            texts = batch.column(1)
            doc_ids = batch.column(0).to_pylist()
            for start, stop in slices(texts):
                values, ends = table.all_ids(texts.slice(start, stop - start))
                before = 0
                for i, after in zip(doc_ids[start:stop], ends.tolist()):
                    n = after - before + 1
                    if parts and size + n > block_ids:
                        yield flush()
                        ids, parts, size, block = [], [], 0, block + 1
                    ids.append(i)
                    parts.append(values[before:after].tobytes() + end)
                    size += n
                    before = after
        if parts:
            yield flush()

    return ordered.mapInArrow(
        run, "shard int, block int, n bigint, doc_ids array<bigint>, lengths array<int>, ids binary"
    )


def _counted(blocks: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all blocks; as many numbers as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), dtype=f"<u{width}"), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    sums = blocks.select("ids").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in sums.collect():
        counts[row.symbol] = row.n
    return counts


_BLOCK = "shard int, block int, n bigint, doc_ids array<bigint>, lengths array<int>, lanes int, words binary, states binary, offsets array<int>, checksum bigint"


def write(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
    end_id: int = END_ID,
) -> None:
    """Encode ``docs`` and write the file set ``path``.

    Documents come in ascending order of their id, a null id first, equal ids in
    the order of their texts.  Null text counts as empty and is one ``end_id``.
    """
    tokenizer, _ = _load_json(tokenizer_path)
    vocabulary = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    plain = staged(_tokenised(docs, tokenizer_path, id_col, text_col, block_ids, end_id), "token-ids")
    table = rans.Frequencies.of_counts(_counted(plain, width, vocabulary))
    seen = np.flatnonzero(table.freq)
    spark = docs.sparkSession
    spark.createDataFrame(
        [(int(s), int(table.freq[s]), table.bits, vocabulary) for s in seen] or [(0, 0, table.bits, vocabulary)],
        "symbol int, freq bigint, bits int, vocabulary int",
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    bits, freq = table.bits, table.freq.astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Frequencies.of_freq(bits, freq)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), dtype=f"<u{width}")
                b = rans.encode_block(ids, shared)
                yield pa.record_batch(
                    [
                        *(batch.column(c)[i : i + 1] for c in ("shard", "block", "n", "doc_ids", "lengths")),
                        pa.array([b.lanes], pa.int32()),
                        pa.array([b.words], pa.binary()),
                        pa.array([b.states], pa.binary()),
                        pa.array([b.offsets], pa.list_(pa.int32())),
                        pa.array([b.checksum], pa.int64()),
                    ],
                    names=["shard", "block", "n", "doc_ids", "lengths", "lanes", "words", "states", "offsets", "checksum"],
                )

    plain.mapInArrow(code, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    # one row for each block; the order over shards is that of as many rows as shards
    per_block = plain.select("shard", "block", "n")
    per_shard = per_block.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = (
        per_block.join(bases, "shard")
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .select("shard", "block", "start", "n")
    )
    index.write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    ``with_ids`` adds the ids as little-endian unsigned 32-bit integers.  A block
    that does not match its checksum fails the job.
    """
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # as many as the vocabulary at most
    bits, vocabulary = rows[0].bits, rows[0].vocabulary
    freq = np.zeros(vocabulary, dtype=np.int64)
    for row in rows:
        freq[row.symbol] = row.freq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Frequencies.of_freq(bits, freq)
        for batch in batches:
            for row in batch.to_pylist():
                block = rans.Block(
                    row["n"], row["lanes"], row["words"], row["states"], row["offsets"], row["checksum"]
                )
                ids = rans.decode_block(block, shared).astype("<u4")
                ends = np.cumsum(row["lengths"])
                parts = [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]
                columns = [
                    pa.array([row["shard"]] * len(parts), pa.int32()),
                    pa.array([row["block"]] * len(parts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - row["lengths"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["shard", "block", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    schema = "shard int, block int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    pieces = bounded_batches(spark.read.schema(_BLOCK).parquet(f"{path}/blocks")).mapInArrow(run, schema + ", ids binary" * with_ids)
    index = spark.read.parquet(f"{path}/index").select("shard", "block", F.col("start").alias("block_start"))
    return pieces.join(index, ["shard", "block"]).select(
        "doc_id",
        (F.col("block_start") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def write_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the file set (into the shared folder, if ``path`` is None) and read it."""
    spark = docs.sparkSession
    if path is None:
        path = scratch_path(spark, "token-files")  # deleted at the end of the driver
    write(docs, tokenizer_path, path, **options)
    return read(spark, path)
