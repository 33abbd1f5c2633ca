"""Encoding text columns piece by piece, each different piece once a worker.

Texts are cut where a byte-level BPE tokenizer certainly starts a new word.  The
split pattern never lets a match run from a letter, number or mark into white
space, or from a letter or number into a comma or full stop, and what it matches
from a position on depends on the text to the right only.  So a cut there changes
no token, wherever the pieces are encoded.  Cutting and counting are Arrow
functions over whole columns; Python sees each different piece of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and ids of pieces, that a worker keeps before it starts anew.
MOST_PIECES, MOST_IDS = 400_000, 5_000_000
#: Bytes of text handled at once.
BATCH_BYTES = 8_000_000

# Where the cuts would not be safe: a space or line feed after any white space, a
# comma or full stop after what is no letter or number.  Such texts are cut at
# spaces only, in Python.
_unsafe = r"\x00|\x01|[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]|[^\pL\pN][.,]|^[.,]"
_word_start = re.compile(r"(?<=\S)(?=\s)")
_begins, _bare = "\0", "\1"


def piece_text(key: str) -> str:
    """The characters that a key stands for: a space comes first unless marked."""
    if key[:1] in (_begins, _bare):
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def slices(column: pa.Array, most_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield start, stop
        start = stop
    # Arrow keeps what it freed; a worker lives on through stages that need it elsewhere
    pa.default_memory_pool().release_unused()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def balanced(texts: list[str], most_chars: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most_chars`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class PieceTable:
    """Ids of pieces by key.

    ``encode`` takes texts and gives an order of them, their ids in that order,
    one after the other, and the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[int], np.ndarray, np.ndarray]], kind: str, added: tuple[str, ...] = ()):
        self.encode, self.kind, self.added = encode, np.dtype(kind), added
        self._start_anew()

    def _start_anew(self) -> None:
        self.number: dict[str, int] = {}
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=self.kind)
        self.pieces = self.used = 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = self.pieces + len(sizes), self.used + len(ids)
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[self.pieces : n] = sizes
        self.start[self.pieces : n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : total] = ids
        self.pieces, self.used = n, total

    def _numbers(self, keys: list[str]) -> np.ndarray:
        found = list(map(self.number.get, keys))
        if None in found:
            new = list(dict.fromkeys(k for k, i in zip(keys, found) if i is None))
            first = self.pieces
            order, ids, sizes = self.encode([piece_text(k) for k in new])
            self._append(ids, sizes)
            self.number.update(zip((new[i] for i in order), range(first, self.pieces)))
            found = list(map(self.number.__getitem__, keys))
        return np.array(found, dtype=np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of ``texts``, and where each text's pieces end."""
        # an added token is cut out before the pattern applies: such a text stays whole
        unsafe = pc.match_substring_regex(texts, "|".join([_unsafe, *map(re.escape, self.added)]))
        marked = pc.binary_join_element_wise(pa.scalar(_begins, texts.type), texts, pa.scalar("", texts.type))
        for char, key in (("\n", "\n"), (",", _bare + ","), (".", _bare + ".")):
            marked = pc.replace_substring(marked, char, " " + key)
        marked = pc.if_else(unsafe, pa.scalar("", texts.type), marked)
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ends = lists.offsets.to_numpy()[1:].astype(np.int64)
        rows = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        if not len(rows):
            return numbers, ends
        # the few texts that need care: each has one empty piece here, to be replaced
        parts, cursor, sizes = [], 0, np.diff(ends, prepend=0)
        for row in rows.tolist():
            text = texts[row].as_py()
            whole = any(a in text for a in self.added)
            keys = [_begins + x for x in ([text] if whole else _word_start.split(text))]
            own = self._numbers(keys)
            parts += [numbers[cursor : int(ends[row]) - 1], own]
            cursor = int(ends[row])
            sizes[row] = len(own)
        return np.concatenate([*parts, numbers[cursor:]]), np.cumsum(sizes)

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > MOST_PIECES or self.used > MOST_IDS:
            self._start_anew()
        return self._cut(pc.fill_null(column, "").cast(pa.large_string()))

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text; null has none."""
        numbers, ends = self._pieces(column)
        total = np.concatenate([[0], np.cumsum(self.size[numbers])])
        return np.diff(total[np.concatenate([[0], ends])])

    def all_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end."""
        numbers, ends = self._pieces(column)
        sizes = self.size[numbers]
        total = np.concatenate([[0], np.cumsum(sizes)])
        # of a batch and of what a worker keeps, both far below 2**31
        at = np.repeat((self.start[numbers] - total[:-1]).astype(np.int32), sizes) + np.arange(total[-1], dtype=np.int32)
        return self.ids[at], total[ends]


def gathered(parts: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``parts`` with these numbers, joined, and where each ends."""
    sizes = size[numbers]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(len(parts), total) < 1 << 31 else np.int64
    at = np.repeat((start[numbers] - ends + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)
    return parts[at], ends


#: Pieces that go to the tokenizer as one text.
JOINED = 100


class JoinedEncoder:
    """Encodes many short pieces through few calls of a byte-level tokenizer.

    Pieces that begin with a space or line feed and end in no white space are
    put one after the other, which is safe for the reasons above, and the ids
    are dealt out again by the bytes that each id stands for.  A piece that
    begins with a comma or full stop gets a letter before it, whose ids are left
    out.  All others, and all with added tokens, are encoded alone.
    """

    def __init__(self, tokenizer, added: tuple[str, ...], kind: str):
        self.tokenizer, self.added, self.kind = tokenizer, added, kind
        sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(token)  # one character of the byte alphabet for each byte
        self.bytes_of = sizes

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.kind) for x in encoded]

    def __call__(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        spaced, bare, alone = [], [], []
        for i, p in enumerate(pieces):
            if 1 < len(p) < 100 and not p[-1].isspace() and not p[1].isspace() and p[0] in " \n,.":
                (bare if p[0] in ",." else spaced).append(i)
            else:
                alone.append(i)
        stretches = [[pieces[i] for i in spaced], [s for i in bare for s in (" x", pieces[i])]]
        texts = ["".join(s[k : k + JOINED]) for s in stretches for k in range(0, len(s), JOINED)]
        if any(a in t for t in texts for a in self.added):
            alone, spaced, bare, texts, stretches = list(range(len(pieces))), [], [], [], [[], []]
        ids = np.concatenate([np.empty(0, dtype=self.kind), *self._ids(texts)])
        ends = np.cumsum([len(p.encode()) for s in stretches for p in s])
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1
        sizes = np.diff(stops, prepend=0)
        if bare:
            keep = np.ones(len(sizes), dtype=bool)
            keep[len(spaced) :: 2] = False
            ids, sizes = ids[np.repeat(keep, sizes)], sizes[keep]
        rest: list[np.ndarray] = []
        for part in balanced([pieces[i] for i in alone], 1_000_000):
            rest += self._ids([pieces[i] for i in alone[part]])
        return (
            [*spaced, *bare, *alone],
            np.concatenate([ids, *rest]),
            np.concatenate([sizes, np.array([len(r) for r in rest], dtype=np.int64)]).astype(np.int64),
        )
