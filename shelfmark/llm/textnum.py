"""Whole batches of texts as numpy arrays: word bounds, 64-bit hashes of words and of windows of words.

A batch is one byte buffer and the offsets of its texts. Words are the maximal runs of bytes other than
space and 0x09 to 0x0D; UTF-8 never uses these bytes inside a longer character, so bytes suffice.
"""

from __future__ import annotations

import numpy as np
import xxhash

WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_M1, _M2, _SEED = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * _M2
    return h ^ (h >> U(29))


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of all words, and first: the words of text i are first[i] to first[i + 1]."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    ws = WS[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ws[:-1]
    after[-1], after[:-1] = True, ws[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~ws & before), np.flatnonzero(~ws & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time over all ranges together."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _M1 ^ _SEED)
    at = np.flatnonzero(size > 0)
    for k in range(0, _LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        v = words[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
        h[at] = mix((h[at] ^ v) * _M1)
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), 7)
    return h


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width hashes; empty where there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, _SEED)
    for j in range(width):
        acc = (acc ^ h[j : j + n]) * _M1
        acc ^= acc >> U(31)
    return mix(acc)


def windows_inside(first: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Whether the window of width words from each word stays in its text."""
    last = np.repeat(first[1:], np.diff(first))
    return (np.arange(n_words) + width) <= last


def repeated_in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key whether its text has it twice or more."""
    order = np.lexsort((keys, doc)) if len(keys) else np.zeros(0, np.int64)
    k, d = keys[order], doc[order]
    same = np.zeros(len(k) + 1, bool)
    if len(k) > 1:
        same[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(flags: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which words lie in a flagged window; flags[i]: the window from word i."""
    d = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(flags)
    d[at] += 1
    np.subtract.at(d, np.minimum(at + width, n_words), 1) if len(at) else None
    return np.cumsum(d[:-1]) > 0


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each text's words."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def normalised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words joined by one space (A-Z lower-cased if asked), with the new starts and ends."""
    size = ends - starts
    room = size + 1
    new_ends = np.cumsum(room) - 1
    new_starts = new_ends - size
    out = np.full(int(room.sum()), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[new_ends] = False
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    out[keep] = buf[np.cumsum(inside[:-1]) > 0]
    return (LOWER[out] if lower else out), new_starts, new_ends
