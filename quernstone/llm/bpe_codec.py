"""Encoding a text column to BPE ids and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .base import bounded_batches
from .piece_table import PieceTable, gathered, slices


#: Bytes of text handled at once; ids, digests and decoded bytes are many times that.
SLICE_BYTES = 4_000_000


@cache
def _encoder(path: str, pattern: str) -> PieceTable:
    """Ids of text columns, kept by the worker."""
    codec = bpe.load(path)
    find = regex.compile(pattern).findall

    def encode_pieces(pieces: list[str]) -> tuple[range, np.ndarray, np.ndarray]:
        split = [[w.encode() for w in find(p)] for p in pieces]
        words = list(dict.fromkeys(w for ws in split for w in ws))
        found = codec.encode(words)
        number = {w: i for i, w in enumerate(words)}
        size = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.concatenate([np.empty(0, dtype=np.int64), *found])
        numbers = np.array([number[w] for ws in split for w in ws], dtype=np.int64)
        ids, _ = gathered(flat, np.cumsum(size) - size, size, numbers)
        total = np.concatenate([[0], np.cumsum(size[numbers])])
        ends = np.cumsum([len(ws) for ws in split], dtype=np.int64) if split else np.empty(0, dtype=np.int64)
        return range(len(pieces)), ids.astype("<u4"), np.diff(total[ends], prepend=0)

    return PieceTable(encode_pieces, "<u4")


def _whole_pattern(pattern: str) -> bool:
    """Whether ``pieces`` knows where this pattern starts words."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of
    the bytes that decoding these ids gives.  ``with_ids`` adds ``ids``, those
    little-endian bytes.  Null text is the empty text and has no ids.  Repeated
    rows are encoded each, other columns are ignored, no rows give no rows.
    Characters that no alternative of ``pattern`` matches have no ids.
    """
    if not _whole_pattern(pattern):
        raise ValueError("texts are cut where public_tokenizers.PATTERN starts words")
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codec = _encoder(ranks_path, pattern), bpe.load(ranks_path)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                ids, ends = table.all_ids(batch.column(1).slice(start, stop - start))
                data, byte_ends = codec.decode_all(ids)
                cuts = [0, *ends.tolist()]
                at = np.concatenate([[0], byte_ends])[cuts].tolist()
                raw = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                columns = [
                    batch.column(0).slice(start, stop - start),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` from little-endian 32-bit ids; null ids give null."""
    picked = bounded_batches(rows).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(ranks_path)
        for batch in batches:
            texts = [
                None if x is None else codec.decode(np.frombuffer(x, dtype="<u4")).decode("utf-8", "replace")
                for x in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
