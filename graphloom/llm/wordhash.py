"""Vectorised 64-bit hashes of the words in UTF-8 buffers."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash, and the final mixing multipliers.
BASE, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 20

#: Byte tables: A-Z lowered; bytes of words made of digits, letters and non-ASCII; non-space bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
WORD_BYTES[65:91] = True
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[32, 9, 10, 11, 12, 13]] = False

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 4096) - 1, BASE, np.uint64)]))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def runs(data: np.ndarray, ends: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes; no run crosses a document's end."""
    inside = member[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = inside[1:] & inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined[cuts - 1] = False
    return np.flatnonzero(inside & np.concatenate([[True], ~joined])), np.flatnonzero(inside & np.concatenate([~joined, [True]])) + 1


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for disjoint ascending runs, none empty."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # pieces of bounded size
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
        a, b = start[at:to], end[at:to]
        sizes = b - a
        heads = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(heads, sizes)
        picked = values[place + np.repeat(a, sizes)].astype(np.uint64) + np.uint64(1)
        picked *= powers(int(sizes.max()))[place]
        out[at:to] = np.add.reduceat(picked, heads)
        at = to
    return mix(out + (end - start).astype(np.uint64) * MIX2)


def word_hashes(data: np.ndarray, ends: np.ndarray, member: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word, in order.  `table` maps bytes first."""
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    start, end = runs(data, ends, member)
    return run_hashes(table[data], start, end), np.searchsorted(ends, start, side="right") - 1
