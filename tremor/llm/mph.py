"""Minimal perfect hashing of 128-bit keys by levels of bits.

A key sets one bit per level; keys alone on their bit stay there, the others
go to the next level. The slot of a key is the number of set bits before its
own, so n keys get the slots 0..n-1.
"""

from __future__ import annotations

import numpy as np

GAMMA, MAX_LEVELS = 2.0, 64
BLOCK_WORDS = 8  # a count of set bits is stored for every 512 bits


def mix(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.astype(np.uint64) ^ (h2.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h2, h1, 1000) >> np.uint64(32)).astype(np.uint32)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, bits as 64-bit words, set bits before each block of words) for distinct keys."""
    sizes, parts, left = [], [], np.arange(len(h1))
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-int(GAMMA * len(left) + 1) // 64) * 64
        at = (mix(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        left = left[~alone[at]]
    flags = np.concatenate(parts) if parts else np.zeros(0, bool)
    flags = np.pad(flags, (0, -len(flags) % (64 * BLOCK_WORDS)))
    words = np.packbits(flags, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
    return np.array(sizes, "<i4"), words, (np.cumsum(counts) - counts).astype("<u4")


def rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each position: the stored count of its block and the words of that block only."""
    block, word = at // (64 * BLOCK_WORDS), (at >> 6) % BLOCK_WORDS
    rows = words.reshape(-1, BLOCK_WORDS)[block]
    before = np.where(np.arange(BLOCK_WORDS) < word[:, None], rows, np.uint64(0))
    own = rows[np.arange(len(at)), word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return ranks[block].astype(np.int64) + np.bitwise_count(before).sum(axis=1, dtype=np.int64) + np.bitwise_count(own)


def slots(sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where a key certainly was not among those built."""
    out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + (mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
        hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[left[hit]] = rank(words, ranks, at[hit])
        left, base = left[~hit], base + int(size)
    return out
