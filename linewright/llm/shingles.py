"""Words of many texts at once as 64-bit hashes, and their distinct shingles.

The texts of an Arrow column are one buffer of bytes. A polynomial prefix hash over it gives the hash of each word from
two look-ups, and one over the words' hashes that of any run of words, so no word becomes an object of its own. Buffers
are taken in parts of a bounded size; memory follows the bytes of a slice, whatever the length of a text or word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a buffer; a longer word than LONG has a digest of its own. Powers that are kept for later calls.
BUFFER, LONG, KEPT = 1 << 20, 1 << 12, 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse; up to KEPT of them stay for later calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = min(KEPT, 1 << (n - 1).bit_length()) if n <= KEPT else n
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        if size <= KEPT:
            self.up, self.down = up, down
        return up[:n], down[:n]


_powers = _Powers()


#: A-Z in lower case, and every white space as a space.
_PLAIN = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")), np.uint8)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) of all texts in turn, and the count of each text's. Nulls have none."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges -= edges[0]
    raw = _PLAIN[raw]
    inside = raw != 0x20
    fresh = np.zeros(len(raw) + 1, bool)  # where a text begins
    fresh[edges] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | fresh[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | fresh[1:])) + 1 if len(raw) else starts
    counts = np.diff(np.searchsorted(starts, edges))
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BUFFER, "right")))
        first, last = int(starts[at]), int(ends[to - 1])
        if last - first > BUFFER:  # one long word
            hashes[at] = 0
        else:
            up, down = _powers.to(last - first + 1)
            prefix = np.zeros(last - first + 1, np.uint64)
            np.cumsum((raw[first:last].astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
            s = starts[at:to] - first
            hashes[at:to] = mix((prefix[ends[at:to] - first] - prefix[s]) * down[s])
        at = to
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes, counts


class Runs:
    """Hashes of runs of words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers.to(len(hashes) + 1)
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.prefix[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the runs from word first to word last, both included."""
        return mix((self.prefix[last + 1] - self.prefix[first]) * self.down[first])

    def every(self, width: int) -> np.ndarray:
        """Of all runs of so many words, in order."""
        n = max(0, len(self.prefix) - width)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n])


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of `width` words (all its words, where fewer)."""
    out = [np.zeros(0, np.uint64)] * len(counts)
    runs = Runs(hashes)
    full = runs.every(width)
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero(counts).tolist():
        a, n = int(first[i]), int(counts[i])
        out[i] = np.unique(full[a : a + n - width + 1]) if n >= width else runs(np.array([a]), np.array([a + n - 1]))
    return out


def min_hashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row i: the least value of each linear hash over set i. Every set has a member."""
    flat = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(a)), np.uint64)
    for i in range(len(a)):
        out[:, i] = np.minimum.reduceat(flat * a[i] + b[i], offsets)
    return out
