"""BPE encoding and decoding by a priority queue of merge ranks.

The symbols of a pre-token are a doubly linked list over its bytes.  A heap holds
(merge rank, position) of every pair that can merge; the least is taken, skipped
where an earlier merge changed its symbols, and the pairs that a merge makes are
pushed.  So a pre-token of n bytes takes O(n log n), however long it is.  Decoding
concatenates vocabulary strings, whose characters stand for bytes.

Texts are cut into pieces and kept by the worker as in ``piece_table``; the heap
sees each different pre-token of new pieces once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches
from .piece_table import PieceTable, gathered, slices

#: Bytes of text handled at once; ids, digests and decoded bytes are many times that.
SLICE_BYTES = 4_000_000
#: Where byte-level tokenizers split texts into pre-tokens; a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_POSITION_BITS = 40
_POSITION = (1 << _POSITION_BITS) - 1


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class HeapBpe:
    """Encoder and decoder for a vocabulary of strings and an ordered list of merges.

    ``added`` are whole strings with ids of their own, cut out of a text before
    anything else, the leftmost first and of those the longest.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        alphabet = byte_alphabet()
        missing = [c for c in alphabet if c not in vocab]
        if missing:
            raise ValueError(f"{len(missing)} bytes have no token")
        self.added = dict(added or {})
        self.byte_ids = [vocab[c] for c in alphabet]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for left, right in merges:
            # a pair given twice has its last rank
            self.rank[vocab[left] << 32 | vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        everything = vocab | self.added
        self.size = max(everything.values()) + 1
        byte_of = {c: b for b, c in enumerate(alphabet)}
        strings = [b""] * self.size
        for token, i in everything.items():
            # a string with a character outside the alphabet stands for itself
            strings[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.strings = strings
        self._flat, self._first, self._sizes = _table(strings)
        self._digits = _table([b"%d," % i for i in range(self.size)])
        self._cut = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._words = regex.compile(SPLIT).findall

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = list(map(self.byte_ids.__getitem__, word))
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank, self.made
        queue = [r << _POSITION_BITS | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            first = heappop(queue)
            at = first & _POSITION
            if ids[at] < 0 or (right := after[at]) >= n or rank.get(ids[at] << 32 | ids[right]) != first >> _POSITION_BITS:
                continue  # stale: merged into its left neighbour, now the last, or another pair
            ids[at], ids[right] = made[first >> _POSITION_BITS], -1
            after[at] = beyond = after[right]
            if beyond < n:
                before[beyond] = at
                if (r := rank.get(ids[at] << 32 | ids[beyond])) is not None:
                    heappush(queue, r << _POSITION_BITS | at)
            if (left := before[at]) >= 0 and (r := rank.get(ids[left] << 32 | ids[at])) is not None:
                heappush(queue, r << _POSITION_BITS | left)
        return [i for i in ids if i >= 0]

    def _plain(self, text: str, known: dict[str, list[int]]) -> list[int]:
        out: list[int] = []
        for word in self._words(text):
            if (ids := known.get(word)) is None:
                known[word] = ids = self.encode_word(word.encode())
            out += ids
        return out

    def encode(self, text: str, known: dict[str, list[int]] | None = None) -> list[int]:
        """Token ids of a text; ``known`` keeps those of pre-tokens."""
        known = {} if known is None else known
        if self._cut is None:
            return self._plain(text, known)
        out: list[int] = []
        end = 0
        for m in self._cut.finditer(text):
            out += self._plain(text[end : m.start()], known)
            out.append(self.added[m.group()])
            end = m.end()
        return out + self._plain(text[end:] if end else text, known)

    def encode_pieces(self, pieces: list[str]) -> tuple[range, np.ndarray, np.ndarray]:
        known: dict[str, list[int]] = {}
        found = [self.encode(p, known) for p in pieces]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return range(len(pieces)), np.fromiter((i for ids in found for i in ids), dtype="<u4", count=int(sizes.sum())), sizes

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and where each id's bytes end."""
        return gathered(self._flat, self._first, self._sizes, ids)

    def digits_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, a comma after each, and where each one's comma ends."""
        return gathered(*self._digits, ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a token nothing."""
        return b"".join(self.strings[i] for i in ids if 0 <= i < self.size).decode("utf-8", "replace")


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings one after the other, where each starts, and its size."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


@cache
def load(path: str) -> HeapBpe:
    """The tokenizer file at ``path``, kept by the worker; other kinds than plain byte-level BPE are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (
        spec.get("normalizer") is not None
        or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space")
        or not pre.get("use_regex", True)
        or (spec.get("decoder") or {}).get("type") != "ByteLevel"
        or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        or any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
    ):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return HeapBpe(model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", ())})


@cache
def _encoder(path: str) -> PieceTable:
    """Ids of text columns, kept by the worker."""
    codec = load(path)
    return PieceTable(codec.encode_pieces, "<u4", tuple(codec.added))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``.

    Strings of added tokens become these tokens, nothing else is added, truncated
    or padded.  The digests are of the decimal ids joined by commas and of the
    text that decoding these ids gives, special tokens kept.  ``with_ids`` adds
    ``ids``, an array of int.  Null text is the empty text and has no ids.
    Repeated rows are encoded each, other columns are ignored whatever their
    names, no rows give no rows.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codec = _encoder(tokenizer_path), load(tokenizer_path)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                ids, ends = table.all_ids(batch.column(1).slice(start, stop - start))
                cuts = np.concatenate([[0], ends])
                digests = []
                for bytes_, byte_ends, less in ((*codec.digits_all(ids), 1), (*codec.decode_all(ids), 0)):
                    at = np.concatenate([[0], byte_ends])[cuts].tolist()
                    parts = (bytes_[a : max(a, b - less)].tobytes() for a, b in zip(at, at[1:]))
                    digests.append(pa.array([hashlib.sha256(p if less else p.decode("utf-8", "replace").encode()).hexdigest() for p in parts], pa.string()))
                columns = [batch.column(0).slice(start, stop - start), pa.array(np.diff(cuts), pa.int64()), *digests]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` from arrays of ids; null arrays give null, ids without a token or null ones nothing."""
    picked = bounded_batches(rows).select(F.col(id_col).alias("id"), F.filter(ids_col, lambda i: i.isNotNull()).cast("array<bigint>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(tokenizer_path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
