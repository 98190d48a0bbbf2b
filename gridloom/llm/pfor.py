"""Patched frame-of-reference files of unsigned 32-bit integers.

Layout (little-endian): magic ``PFOR``, uint32 block size, uint64 number of values, then the index
(one uint32 start per block and one past the last, counted from the end of the index), then the blocks.  A
block is: uint32 minimum, uint8 width, uint16 number of exceptions, the values minus the minimum in
``width`` bits each (low bits only, big-endian bit order, padded to a byte), the exceptions' places (uint16) and
their whole differences (uint32).  The width covers the chosen percentile of the block's differences.
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"PFOR", 1024, 95.0
_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("n", "<u2")])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    if not 0 < block < 1 << 16:
        raise ValueError("a block holds 1 to 65535 values")
    n = len(values)
    count = -(-n // block)
    grid = np.zeros((count, block), np.uint32)
    grid.ravel()[:n] = values
    if n % block:
        grid[-1, n % block :] = grid[-1, 0]
    least = grid.min(1) if count else np.zeros(0, np.uint32)
    diff = grid - least[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = _bits(np.partition(diff, rank, axis=1)[:, rank]) if count else np.zeros(0, np.int64)
    over = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    extra = over.sum(1)
    packed = (width * block + 7) // 8
    size = _HEAD.itemsize + packed + 6 * extra
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), np.uint8)
    heads = np.zeros(count, _HEAD)
    heads["least"], heads["width"], heads["n"] = least, width, extra
    if count:
        out[start[:-1, None] + np.arange(_HEAD.itemsize)] = heads.view(np.uint8).reshape(count, -1)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        low = (diff[rows] & np.uint32((1 << int(w)) - 1)).astype(">u4")
        bits = np.unpackbits(low.view(np.uint8).reshape(len(rows), block, 4), axis=2)[:, :, 32 - w :]
        body = np.packbits(bits.reshape(len(rows), -1), axis=1)
        out[(start[rows] + _HEAD.itemsize)[:, None] + np.arange(body.shape[1])] = body
    for b in np.flatnonzero(extra):
        at = int(start[b] + _HEAD.itemsize + packed[b])
        place = np.flatnonzero(over[b])
        tail = place.astype("<u2").tobytes() + diff[b, place].astype("<u4").tobytes()
        out[at : at + len(tail)] = np.frombuffer(tail, np.uint8)
    return MAGIC + np.uint32(block).astype("<u4").tobytes() + np.uint64(n).astype("<u8").tobytes() + start.astype("<u4").tobytes() + out.tobytes()


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values ``first`` up to ``last``; the index leads straight to their blocks."""
    if data[:4] != MAGIC:
        raise ValueError("not a PFOR file")
    block, n = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0])
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    count = -(-n // block)
    start = np.frombuffer(data, "<u4", count + 1, 16).astype(np.int64) + 16 + 4 * (count + 1)
    a, z = first // block, -(-last // block)
    buf = np.frombuffer(data, np.uint8)
    start = start[a:z]
    heads = np.ascontiguousarray(buf[start[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).ravel()
    width = heads["width"].astype(np.int64)
    out = np.zeros((z - a, block), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        body = buf[(start[rows] + _HEAD.itemsize)[:, None] + np.arange((int(w) * block + 7) // 8)]
        bits = np.zeros((len(rows), block, 32), np.uint8)
        bits[:, :, 32 - w :] = np.unpackbits(body, axis=1)[:, : block * int(w)].reshape(len(rows), block, int(w))
        out[rows] = np.packbits(bits, axis=2).view(">u4")[:, :, 0]
    for b in np.flatnonzero(heads["n"]):
        at, k = int(start[b] + _HEAD.itemsize + (width[b] * block + 7) // 8), int(heads["n"][b])
        out[b, np.frombuffer(data, "<u2", k, at)] = np.frombuffer(data, "<u4", k, at + 2 * k)
    out += heads["least"].astype(np.uint32)[:, None]
    return out.ravel()[first - a * block : last - a * block]
