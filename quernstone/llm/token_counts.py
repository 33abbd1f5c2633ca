"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches
from .piece_table import JoinedEncoder, PieceTable, balanced, slices, texts_of

#: Characters that one call of the tokenizer gets.
BATCH_CHARS = 1_000_000
#: Texts with more tokens are over the limit.
TOKEN_LIMIT = 512


def _load_json(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if hasattr(tokenizer.model, "_resize_cache"):
        # pieces come once, so the library need not remember them
        model = tokenizer.model
        model._resize_cache(0)
        tokenizer.model = model
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return tokenizer, added


@cache
def _counter(path: str):
    """A function from a text column to token counts, kept by the worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: [len(x) for x in model.encode(texts_of(column), num_threads=1)]
    tokenizer, added = _load_json(path)
    if _splits_like_byte_level(tokenizer):
        kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        return PieceTable(JoinedEncoder(tokenizer, added, kind), kind, added).lengths

    def lengths(column: pa.Array) -> list[int]:
        texts, found = texts_of(column), []
        for part in balanced(texts, BATCH_CHARS):
            encoded = tokenizer.encode_batch_fast(texts[part], add_special_tokens=False)
            found += [len(x) for x in encoded]
        return found

    return lengths


def _splits_like_byte_level(tokenizer) -> bool:
    """Whether ``pieces`` knows where this tokenizer starts words."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    return (
        spec["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre["add_prefix_space"]
    )


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Null text has 0 bytes and 0 tokens; repeated rows are counted each; other
    columns, whatever their names, are ignored; no rows give no rows.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            tokens: list[int] = []
            for start, stop in slices(texts):
                tokens.extend(lengths(texts.slice(start, stop - start)))
            sizes = pc.fill_null(pc.binary_length(texts), 0)
            yield pa.record_batch(
                [batch.column(0), sizes.cast(pa.int64()), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
