"""Vectorised byte-level text helpers shared by the Arrow operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents costs a fixed number of numpy passes and no per-word Python
objects.  Null texts count as empty texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes each; a longer row comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(member: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row: starts, ends and, per row, the first run's index.

    ``cut`` lists further places at which a run ends and the next one starts.
    """
    n = len(member)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = member
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if cut is not None:
        edge[cut] = True
    follows = before.copy()  # the byte before belongs to the same run
    follows[edge] = False
    starts = np.flatnonzero(member & ~follows[:n])
    nxt = np.zeros(n + 1, dtype=bool)
    nxt[:n] = member
    ends = np.flatnonzero(before & ~(nxt & ~edge))
    return starts, ends, np.searchsorted(starts, offsets)


def space_words(buf: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, divided further at ``cut``."""
    return spans(~_SPACE[buf], offsets, cut)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (position independent), never 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    h = mix64((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    h[h == 0] = 1
    return h


def crc_mod(ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo ``modulus``."""
    return np.array([zlib.crc32(str(int(i)).encode()) % modulus for i in ids], np.int64)


class HashIndex:
    """Open-addressing map from non-zero 64-bit keys to dense ids 0, 1, 2 … in vectorised form."""

    def __init__(self, keys: np.ndarray | None = None):
        self.n = 0
        self._alloc(max(1 << 10, 0 if keys is None else len(keys) * 3 // 2))
        if keys is not None:
            self.add(keys)

    def _alloc(self, least: int) -> None:
        self.bits = int(least - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, ids: np.ndarray) -> None:
        slot, mask = self._home(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.ids[slot[won]] = ids[won]
            keys, ids, slot = keys[~won], ids[~won], (slot[~won] + 1) & mask

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Adds distinct keys that are not there yet; returns their ids."""
        ids = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        if (self.n + len(keys)) * 10 > len(self.keys) * 7:
            old = self.ids >= 0
            k, i = self.keys[old], self.ids[old]
            self._alloc((self.n + len(keys)) * 3)
            self._put(k, i)
        self._put(keys, ids)
        self.n += len(keys)
        return ids

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the keys, -1 where a key is unknown."""
        slot, mask = self._home(keys), len(self.keys) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.ids[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            found = self.keys[slot[left]]
            same = found == keys[left]
            out[left[same]] = self.ids[slot[left[same]]]
            left = left[~same & (found != 0)]
        return out
