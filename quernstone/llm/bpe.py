"""Byte-level BPE by ranks with a hierarchical-bitmap queue of merge ranks.

A bucket for each merge rank holds positions in a linked list of tokens.  Three
levels of 64-bit words say which buckets are filled; find-first-set on each
level gives the lowest rank.  Entries are not deleted when a merge changes their
neighbours: they are skipped as stale when their bucket's turn comes.

All pre-tokens of a batch share one queue, with breaks between them.  Merges in
different pre-tokens do not touch, so the lowest rank of all is the next of
every pre-token that has it, and one bucket is merged in array operations.  One
very long pre-token takes the same path.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import cache

import numpy as np

from .piece_table import gathered

_EMPTY = np.int64(-1)


class RankBitmap:
    """Filled buckets; ``first`` is the lowest one, or -1."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def discard(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def first(self) -> int:
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        return (a << 6) | ((word & -word).bit_length() - 1)


class RankBpe:
    """Encoder and decoder for a vocabulary of ranks, which are the token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self._bytes = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self._size = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self._first = np.cumsum(self._size) - self._size
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(rank)
        self._fill(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: rows that find their slot taken try the next one."""
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self._shift, self._mask = 64 - bits, (1 << bits) - 1
        self._keys = np.full(1 << bits, _EMPTY)
        self._values = np.full(1 << bits, _EMPTY)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] == _EMPTY]
            self._keys[slot[free]] = keys[free]  # the last of equal slots wins
            placed = free[self._keys[slot[free]] == keys[free]]
            self._values[slot[placed]] = values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(self._shift)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; -1 if there is none."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        there = self._keys[slot]
        found = np.where(there == keys, self._values[slot], _EMPTY)
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            there = self._keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return found

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        total = int(sizes.sum())
        if not total:
            return [np.empty(0, dtype=np.int64) for _ in words]
        # one slot past the end stands for "no neighbour"
        none = total
        token = np.empty(total + 1, dtype=np.int64)
        token[:total] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        token[none] = 0
        word_of = np.repeat(np.arange(len(words)), sizes)
        following = np.arange(1, total + 2)
        before = np.arange(-1, total)
        ends = np.cumsum(sizes)[sizes > 0]
        following[ends - 1] = none
        before[(ends - sizes[sizes > 0])] = none
        alive = np.ones(total + 1, dtype=bool)
        alive[none] = False
        rank = np.full(total + 1, -1, dtype=np.int64)

        def ranked(at: np.ndarray) -> np.ndarray:
            nxt = following[at]
            return np.where(nxt == none, -1, self.pair_ranks(token[at], token[nxt]))

        buckets: dict[int, list[np.ndarray]] = defaultdict(list)
        filled = RankBitmap(self.size)

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(ranks[[0, *cuts.tolist()]].tolist(), starts, starts[1:]):
                buckets[r].append(at[a:b])
                filled.add(r)

        every = np.arange(total)
        rank[:total] = ranked(every)
        some = every[rank[:total] >= 0]
        if len(some):
            push(some, rank[some])
        is_right = np.zeros(total + 1, dtype=bool)
        is_head = np.zeros(total + 1, dtype=bool)
        while (r := filled.first()) >= 0:
            filled.discard(r)
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                # in a run of pairs that overlap, each other one
                linked = following[at[:-1]] == at[1:]
                if linked.any():
                    index = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.r_[True, ~linked], index, 0))
                    at = at[(index - start) % 2 == 0]
            at = self._in_turn(r, at, token, following, before, word_of, none, is_right, is_head, buckets, filled)
            right = following[at]
            beyond = following[right]
            token[at] = r
            alive[right] = False
            following[at] = beyond
            before[beyond] = at
            before[none] = none
            left = before[at]
            touched = np.concatenate([at, left[left != none]])
            # the left neighbour of one merge can be the head of another
            touched = np.unique(touched) if len(at) > 1 else touched
            touched = touched[alive[touched]]
            rank[touched] = ranked(touched)
            some = touched[rank[touched] >= 0]
            if len(some):
                push(some, rank[some])
        kept = np.flatnonzero(alive)
        ids = token[kept]
        counts = np.bincount(word_of[kept], minlength=len(words))
        return np.split(ids, np.cumsum(counts)[:-1])

    def _in_turn(self, r, at, token, following, before, word_of, none, is_right, is_head, buckets, filled):
        """The pairs of ``at`` that may merge at once.

        Merging leftmost first, a new pair may rank below ``r`` and so come
        before the next pair of rank ``r`` in that pre-token.  Then only the
        first pair of that pre-token merges now; the others wait in the bucket.
        """
        if len(at) == 1:
            return at
        right = following[at]
        beyond, left = following[right], before[at]
        is_right[right], is_head[at] = True, True
        new = np.full(len(at), r, dtype=np.int64)
        low = np.zeros(len(at), dtype=bool)
        for a, b, there in (
            (np.where(is_right[left], r, token[left]), new, left != none),
            (new, token[beyond], beyond != none),
            (new, np.where(is_head[beyond], r, token[beyond]), beyond != none),
        ):
            made = self.pair_ranks(a, b)
            low |= there & (made >= 0) & (made < r)
        is_right[right], is_head[at] = False, False
        if not low.any():
            return at
        words = word_of[at]
        careful = np.isin(words, words[low])
        first = np.r_[True, words[1:] != words[:-1]]
        now = ~careful | first
        if not now.all():
            buckets[r].append(at[~now])
            filled.add(r)
        return at[now]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and where each id's bytes end."""
        return gathered(self._bytes, self._first, self._size, ids)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def load(path: str) -> RankBpe:
    """The vocabulary at ``path``, kept by the worker."""
    return RankBpe(read_ranks(path))
