"""Words of whole texts, found and hashed a block of bytes at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is
`[^\\x20\\x09-\\x0D]+` of the text. A word's hash takes in its length and then
eight bytes at a time, each step a bijection of 64 bits (longer words: xxh3), so
no two words of up to eight bytes and one length share a hash, and no pattern in
longer ones makes them collide. It depends on the word alone: every task finds
the same. Hashes of two seeds together are 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15 | 1)
#: Words over this many bytes are hashed by xxh3.
_LONG = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


_K = U(0xC2B2AE3D27D4EB4F)
#: The first n bytes of a lane, by n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_LOWER_TABLE = bytes(_LOWER.tolist())


class Words:
    """Word spans of a batch of texts: starts and ends in data, first[i]:first[i+1] being those of text i."""

    def __init__(self, texts: pa.Array):
        if pa.types.is_large_string(texts.type) is False:
            texts = texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
        self.data, self.offsets = self.data[lo:hi], off - lo
        word = ~SPACE[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """Hash of each word; other seeds give hashes that share nothing with these."""
        raw = self.data.tobytes()
        raw = (raw.translate(_LOWER_TABLE) if lower else raw) + bytes(8)
        # the eight bytes from each place on
        lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        left = self.ends - self.starts
        h = _mix(left.astype(U) * _K + U(2 * seed + 1))
        at, who = self.starts, np.arange(len(left))
        while len(who):
            h[who] = _mix(h[who] ^ (lanes[at] & _FIRST[np.minimum(left, 8)]))
            more = np.flatnonzero((left > 8) & (left <= _LONG + 8))
            at, who, left = at[more] + 8, who[more], left[more] - 8
        for i in np.flatnonzero(self.ends - self.starts > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[self.starts[i] : self.ends[i]], 2 * seed + 1)
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring words (len(h) - k + 1 of them), by doubling; each joint is mixed, so that no pattern of words cancels out."""
    if len(h) < k:
        return np.zeros(0, U)
    # acc holds the hashes of `done` words from each place; power doubles the width.
    acc, done, power, width = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            if acc is None:
                acc, done = power, width
            else:
                n = len(h) - done - width + 1
                acc = _mix(acc[:n] * _MULT + power[done : done + n])
                done += width
        rest >>= 1
        if rest:
            n = len(power) - width
            power = _mix(power[:n] * _MULT + power[width : width + n])
            width *= 2
    return _mix(acc[: len(h) - k + 1] + U(k * int(_K) & (2**64 - 1)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
