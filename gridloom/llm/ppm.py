"""Prediction by partial matching over bytes, with frozen statistics, in vectorised form.

A text is the byte sequence of its UTF-8 form closed by byte 255 (which UTF-8 never
uses) and opened by ``order`` such bytes as context.  What is gathered from a corpus are the
counts of all (order + 1)-byte grams; the counts of every shorter context follow from them.

A context with n symbols seen, q of them distinct, gives symbol s the probability
(2 c(s) - 1) / 2n and the escape q / 2n; after an escape the next shorter context counts
only symbols that the longer ones didn't offer (symbol exclusion), down to a uniform
distribution over the bytes that no context offers.  As the statistics are frozen, the
cost of every (context, symbol) is known beforehand: one row of costs per context.
"""

from __future__ import annotations

import numpy as np

from .textscan import HashIndex, mix64

END = 255
_U8 = np.uint64(8)


def padded(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows with their opening and closing bytes, and where each row's symbols end in the list of symbols."""
    lens = np.diff(offsets)
    n = len(lens)
    width = lens + order + 1
    ends = np.cumsum(width)
    out = np.full(int(ends[-1]) if n else 0, END, np.uint8)
    if len(buf):
        shift = np.repeat(np.arange(n, dtype=np.int64) * (order + 1) + order, lens)
        out[np.arange(len(buf)) + shift] = buf
    return out, np.cumsum(lens + 1)


def gram_keys(data: np.ndarray, symbol_ends: np.ndarray, order: int) -> np.ndarray:
    """For every symbol, its order preceding bytes and itself, packed with the symbol lowest."""
    n = len(symbol_ends)
    if not n:
        return np.zeros(0, np.uint64)
    lens = np.diff(np.concatenate([[0], symbol_ends]))
    at = np.arange(int(symbol_ends[-1])) + np.repeat(np.arange(1, n + 1) * order, lens)
    key = data[at].astype(np.uint64)
    for j in range(1, order + 1):
        key |= data[at - j].astype(np.uint64) << np.uint64(8 * j)
    return key


def count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class GramCounter:
    """Counts grams of many batches, merging now and then so that memory follows the distinct grams."""

    def __init__(self, order: int):
        self.order, self.keys, self.counts, self.pending = order, [], [], 0

    def add(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        if len(offsets) > 1:
            k, c = count(gram_keys(*padded(buf, offsets, self.order), self.order))
            self.keys.append(k)
            self.counts.append(c)
            self.pending += len(k)
            if self.pending > 4_000_000:
                self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merge(self.keys, self.counts)
        self.keys, self.counts, self.pending = [k], [c], 0
        return k, c


def _node_key(context: np.ndarray, length: int) -> np.ndarray:
    return mix64(context + np.uint64((length + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)


class ContextRows:
    """Cost rows (log2 units, positive) of one or more models over shared contexts.

    ``models`` lists (grams, counts) of each; a context that a model has not seen takes the row of the
    longest suffix that it has.
    """

    def __init__(self, models: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.order = order
        symbols = np.unique(np.concatenate([m[0] & np.uint64(255) for m in models] + [np.array([END], np.uint64)])).astype(np.int64)
        self.column = np.full(256, len(symbols), np.int64)
        self.column[symbols] = np.arange(len(symbols))
        self.width = len(symbols) + 1
        every = np.unique(np.concatenate([m[0] for m in models]))
        levels = [np.unique((every & self._mask(k + 1)) >> _U8) for k in range(order + 1)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        self.index = HashIndex()
        for k, nodes in enumerate(levels):
            self.index.add(_node_key(nodes, k))
        rows = np.empty((int(starts[-1]), self.width, len(models)), np.float32)
        for i, (grams, counts) in enumerate(models):
            row = excluded = None
            for k, nodes in enumerate(levels):
                sub, total = merge([grams & self._mask(k + 1)], [counts])
                c = np.zeros((len(nodes), self.width), np.float64)
                np.add.at(c, (np.searchsorted(nodes, sub >> _U8), self.column[(sub & np.uint64(255)).astype(np.int64)]), total)
                parent = None if not k else np.searchsorted(levels[k - 1], nodes & self._mask(k - 1))
                row, excluded = self._level(c, parent, row, excluded, counts_above if k else None)
                rows[starts[k] : starts[k + 1], :, i] = row
                counts_above = c
        self.rows = rows.reshape(-1, len(models))

    @staticmethod
    def _mask(n: int) -> np.uint64:
        return np.uint64((1 << (8 * n)) - 1)

    @staticmethod
    def _level(c, parent, row_above, excluded_above, counts_above):
        """Costs of every symbol from the contexts of one length, and the costs after an escape from them."""
        seen = c > 0
        q = seen.sum(1)
        n = c.sum(1)
        if parent is None:
            excluded = np.full(c.shape, np.log2(max(256 - int(q[0]), 1)))
        else:
            left = np.where(seen, 0, counts_above[parent])
            lq, ln = (left > 0).sum(1), left.sum(1)
            below = np.maximum(2 * ln, 1)[:, None]
            with np.errstate(divide="ignore"):
                esc = np.where(lq > 0, -np.log2(np.maximum(lq, 1) / np.maximum(2 * ln, 1)), 0)[:, None]
                excluded = np.where(left > 0, -np.log2(np.maximum(2 * left - 1, 1) / below), esc + excluded_above[parent])
        below = np.maximum(2 * n, 1)[:, None]
        esc = -np.log2(np.maximum(q, 1) / np.maximum(2 * n, 1))[:, None]
        row = np.where(seen, -np.log2(np.maximum(2 * c - 1, 1) / below), esc + excluded)
        if parent is not None:  # contexts that this model hasn't seen
            row = np.where(q[:, None] > 0, row, row_above[parent])
            excluded = np.where(q[:, None] > 0, excluded, excluded_above[parent])
        return row, excluded

    def costs(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every row under every model, end symbol included."""
        data, ends = padded(buf, offsets, self.order)
        if not len(ends):
            return np.zeros((0, self.rows.shape[1]))
        keys = gram_keys(data, ends, self.order)
        context = keys >> _U8
        node = self.index.get(_node_key(context, self.order))
        left = np.flatnonzero(node < 0)
        for k in range(self.order - 1, -1, -1):
            if not len(left):
                break
            node[left] = self.index.get(_node_key(context[left] & self._mask(k), k))
            left = left[node[left] < 0]
        node[left] = 0
        cell = node.astype(np.int64) * self.width + self.column[(keys & np.uint64(255)).astype(np.int64)]
        first = np.concatenate([[0], ends[:-1]])
        return np.stack([np.add.reduceat(self.rows[:, i][cell], first, dtype=np.float64) for i in range(self.rows.shape[1])], 1)


class ContextTree:
    """The same code lengths as ``ContextRows`` for one model, held sparsely: memory follows the distinct grams.

    ``kind`` is the type that counts are kept in; single precision is exact up to 2**24.

    Grams seen at the full order have their cost in one table; only the others walk down
    the shorter contexts, carrying the context through which they escaped, as that one
    decides which symbols are excluded.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, kind: type = np.float32):
        self.order, self.levels = order, []
        above = None
        for k in range(order + 1):
            keys, c = merge([grams & ContextRows._mask(k + 1)], [counts])
            first = np.flatnonzero(np.concatenate([[True], keys[1:] >> _U8 != keys[:-1] >> _U8])) if len(keys) else np.zeros(0, np.int64)
            nodes = keys[first] >> _U8
            owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(keys)]])))
            n = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
            q = np.bincount(owner, minlength=len(first)).astype(np.int16)
            level = {"grams": HashIndex(_node_key(keys, k)), "nodes": HashIndex(_node_key(nodes, k)), "c": c.astype(kind), "n": n, "q": q, "keys": keys}
            if above is not None:
                level["parent"] = np.searchsorted(above["sorted"], nodes & ContextRows._mask(k - 1)).astype(np.int32)
                shared = above["c"][np.searchsorted(above["keys"], keys & ContextRows._mask(k))]
                level["ln"] = above["n"][level["parent"]] - np.bincount(owner, shared, len(first)).astype(np.int64)
                level["lq"] = above["q"][level["parent"]] - q
            level["sorted"] = nodes
            if k == order:
                level["cost"] = (-np.log2((2 * c - 1) / (2 * n[owner]))).astype(np.float32)
            self.levels.append(level)
            above = level
        for level in self.levels:
            del level["keys"], level["sorted"]

    def costs(self, buf: np.ndarray, offsets: np.ndarray, within=None) -> np.ndarray:
        """Code length in bits of every row; ``within`` marks, by its context's last two bytes, the symbols to count."""
        data, ends = padded(buf, offsets, self.order)
        if not len(ends):
            return np.zeros(0)
        keys = gram_keys(data, ends, self.order)
        top = self.levels[-1]
        gram = top["grams"].get(_node_key(keys, self.order))
        hit = gram >= 0
        out = np.zeros(len(keys))
        out[hit] = top["cost"][gram[hit]]
        left = np.flatnonzero(~hit)
        if within is not None:
            own = within[((keys >> _U8) & np.uint64(0xFFFF)).astype(np.int64)]
            out[~own] = 0
            left = left[own[left]]
        via = np.full(len(left), -1, np.int64)
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            level, key = self.levels[k], keys[left] & ContextRows._mask(k + 1)
            node = np.full(len(left), -1, np.int64)
            fresh = via < 0
            node[fresh] = level["nodes"].get(_node_key(key[fresh] >> _U8, k))
            n, q = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
            known = fresh & (node >= 0)
            n[known], q[known] = level["n"][node[known]], level["q"][node[known]]
            if k < self.order:
                from_ = self.levels[k + 1]
                node[~fresh] = from_["parent"][via[~fresh]]
                n[~fresh], q[~fresh] = from_["ln"][via[~fresh]], from_["lq"][via[~fresh]]
            gram = level["grams"].get(_node_key(key, k))
            hit = (gram >= 0) & (n > 0)
            out[left[hit]] += -np.log2((2 * level["c"][gram[hit]] - 1) / (2 * n[hit]))
            escape = ~hit & (q > 0)
            out[left[escape]] += -np.log2(q[escape] / (2 * n[escape]))
            left, via = left[~hit], node[~hit]
        seen = int(self.levels[0]["q"][0]) if len(self.levels[0]["q"]) else 0
        out[left] += np.log2(max(256 - seen, 1))
        return np.add.reduceat(out, np.concatenate([[0], ends[:-1]]))


def normalised(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words (spans) joined by single spaces, and the new row offsets."""
    lens = ends - starts
    size = np.cumsum(np.concatenate([[0], lens + 1]))
    n = np.diff(first)
    spare = np.concatenate([[0], np.cumsum(n > 0)])  # no space after a row's last word
    at = size[first] - spare
    out = np.full(int(at[-1]), 32, np.uint8)
    if len(lens):
        member = np.arange(int(lens.sum()))
        before = np.concatenate([[0], np.cumsum(lens)])[:-1]
        target = size[:-1] - np.repeat(spare[:-1], n) - before
        out[member + np.repeat(target, lens)] = buf[member + np.repeat(starts - before, lens)]
    return out, at
