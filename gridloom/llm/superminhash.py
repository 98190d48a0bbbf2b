"""SuperMinHash signatures (Ertl 2017) over sets of 64-bit elements.

Every element draws a random permutation of the signature's places; at rank j
it offers the value j + r (r uniform in [0, 1)) to place p(j).  The signature
keeps the least offer of every place.  Ranks are offered in rising order, so the
loop ends as soon as every place holds an offer below the next rank.
"""

from __future__ import annotations

import numpy as np

from .textscan import mix64

_FRACTION = np.uint64((1 << 32) - 1)


def _draw(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix64(keys + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def signature(elements: np.ndarray, m: int) -> np.ndarray:
    """The signature as m unsigned 64-bit values: rank in the high half, fraction in the low half.

    ``elements`` holds distinct hashes; an empty set gives all-ones values.
    """
    out = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return out
    where = np.tile(np.arange(m, dtype=np.int16), (n, 1)) if n * m <= 1 << 16 else None
    order = elements
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(n)
    for j in range(m):
        word = _draw(order, j)
        pick = j + ((word >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if where is not None:
            place = where[rows, pick].astype(np.int64)
            where[rows, pick] = where[:, j]
        else:
            place = _swapped(pick, moved, j, m)
        value = (np.uint64(j) << np.uint64(32)) | (word & _FRACTION)
        np.minimum.at(out, place, value)
        if int(out.max()) >> 32 <= j:
            break
    return out


def _swapped(pick: np.ndarray, moved: list[tuple[np.ndarray, np.ndarray]], j: int, m: int) -> np.ndarray:
    """The Fisher-Yates place at ``pick`` after the swaps so far, without the whole arrays.

    ``moved`` lists, per earlier rank, the index written and the place put there.
    """
    def at(index: np.ndarray) -> np.ndarray:
        place = index.copy()
        for written, put in moved:
            place = np.where(written == index, put, place)
        return place

    place = at(pick)
    moved.append((pick, at(np.full_like(pick, j))))
    return place


def bands(sig: np.ndarray, rows: int, count: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values, as signed integers."""
    grid = sig[: rows * count].reshape(count, rows)
    key = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = mix64(key ^ grid[:, i])
    return key.view(np.int64)
