"""Static range asymmetric numeral system over token ids, in numpy.

All blocks share one frequency table.  A block is coded on its own: symbol i
belongs to lane i mod W, each lane has a 64-bit state, and the lanes interleave
their 32-bit words in one stream.  The coder runs from the last row of W symbols
to the first, the decoder the other way.  Every ``CHECKPOINT_ROWS`` rows the
states and the place in the stream are kept, so that a decoder can start there:
``decode_block`` runs all stretches between checkpoints at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 1024
CHECKPOINT_ROWS = 128
_LOW = 31  # states are 2**31 to 2**63


@dataclass
class Frequencies:
    """Shared table: frequency and first slot of each symbol, of 2**bits slots."""

    bits: int
    freq: np.ndarray
    first: np.ndarray
    symbol_of_slot: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        """Scale counts to a power of two; each symbol that occurs keeps a slot."""
        seen = np.flatnonzero(counts)
        bits = min(24, max(12, int(np.ceil(np.log2(max(1, len(seen)) * 4)))))
        total, size = int(counts.sum()), 1 << bits
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(seen):
            exact = counts[seen].astype(np.float64) * size / total
            share = np.maximum(1, np.floor(exact).astype(np.int64))
            rest = size - int(share.sum())
            order = np.argsort(-share, kind="stable")
            if rest > 0:
                share[order[0]] += rest
            i = 0
            while rest < 0:  # too many slots went to rare symbols: the largest give
                at = order[i % len(order)]
                give = min(-rest, max(0, int(share[at]) // 8)) or min(-rest, int(share[at]) - 1)
                share[at] -= give
                rest += give
                i += 1
            freq[seen] = share
        return cls.of_freq(bits, freq)

    @classmethod
    def of_freq(cls, bits: int, freq: np.ndarray) -> Frequencies:
        first = np.concatenate([[0], np.cumsum(freq)[:-1]])
        symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        return cls(bits, freq.astype(np.uint64), first.astype(np.uint64), symbols)


@dataclass
class Block:
    n: int
    lanes: int
    words: bytes
    states: bytes  # of each checkpoint, row 0 first
    offsets: list[int]  # place of each checkpoint in words
    checksum: int  # crc32 of the ids as little-endian unsigned 32-bit integers


def _lanes(n: int) -> int:
    return max(1, min(LANES, 1 << max(0, (n // 64).bit_length() - 1)))


def encode_block(ids: np.ndarray, table: Frequencies) -> Block:
    n, lanes = len(ids), _lanes(len(ids))
    rows = -(-n // lanes)
    state = np.full(lanes, 1 << _LOW, dtype=np.uint64)
    bits, high = np.uint64(table.bits), np.uint64(63 - table.bits)
    freq, first = table.freq[ids], table.first[ids]
    words: list[np.ndarray] = [np.empty(0, dtype="<u4")] * rows
    states: dict[int, bytes] = {}
    for row in range(rows - 1, -1, -1):
        part = slice(row * lanes, min(n, (row + 1) * lanes))
        f = freq[part]
        x = state[: len(f)]
        full = x >= (f << high)
        if full.any():
            words[row] = x[full].astype("<u4")
            x[full] >>= np.uint64(32)
        q = x // f
        x[:] = (q << bits) + (x - q * f) + first[part]
        if row % CHECKPOINT_ROWS == 0:
            states[row] = state.astype("<u8").tobytes()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    marks = sorted(states)
    return Block(
        n,
        lanes,
        b"".join(w.tobytes() for w in words),
        b"".join(states[r] for r in marks),
        [int(places[r]) for r in marks],
        zlib.crc32(ids.astype("<u4").tobytes()),
    )


def decode_block(block: Block, table: Frequencies, check: bool = True) -> np.ndarray:
    if not block.n:
        return np.empty(0, dtype=np.uint32)
    lanes, n = block.lanes, block.n
    words = np.frombuffer(block.words, dtype="<u4").astype(np.uint64)
    words = np.append(words, np.zeros(1, dtype=np.uint64))
    state = np.frombuffer(block.states, dtype="<u8").reshape(-1, lanes).astype(np.uint64)
    place = np.array(block.offsets, dtype=np.int64)
    stretches = len(state)
    rows = -(-n // lanes)
    out = np.zeros((stretches, CHECKPOINT_ROWS, lanes), dtype=np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    lane = np.arange(lanes)
    for step in range(min(rows, CHECKPOINT_ROWS)):
        slot = state & mask
        symbol = table.symbol_of_slot[slot]
        out[:, step] = symbol
        new = table.freq[symbol] * (state >> bits) + slot - table.first[symbol]
        # the last stretch can end early, in the middle of a row
        left = n - ((stretches - 1) * CHECKPOINT_ROWS + step) * lanes
        if left < lanes:
            new[-1] = np.where(lane < left, new[-1], state[-1])
        short = new < np.uint64(1 << _LOW)
        if left < lanes:
            short[-1] &= lane < left
        taken = np.cumsum(short, axis=1)
        at = np.minimum(place[:, None] + taken - 1, len(words) - 1)
        state = np.where(short, (new << np.uint64(32)) | words[at], new)
        place += taken[:, -1]
    ids = out.reshape(-1)[:n]
    if check and zlib.crc32(ids.astype("<u4").tobytes()) != block.checksum:
        raise ValueError("a block of token ids does not match its checksum")
    return ids
