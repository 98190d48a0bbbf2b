"""FLAC streams of 8-bit mono samples in frames of 576, written and read for many streams at once.

The writer chooses per frame between constant, verbatim, fixed order 0 and 1, and linear
prediction of order 2, whichever is shortest, with one Rice partition.  The reader
handles constant, verbatim, fixed orders 0-4 and linear predictors up to order 32, with any
number of Rice partitions and escaped (raw) ones; it verifies the header CRC-8, the frame CRC-16 and the
stream's MD5, and finds frames by the seek table, or by their sync codes where there is none.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 576
#: Fixed values of the format: sample and frame codes for "576 samples, rate from the header, mono, 8 bits".
_FRAME = bytes([0xFF, 0xF8, 0x20, 0x02])
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_LPC_BITS, _LPC_SHIFT = 10, 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1), (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _right_aligned(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Column-major bytes of each span, zero-filled in front (both CRCs start at 0, so leading zeros don't count)."""
    width = int(lens.max()) if len(lens) else 0
    at = starts + lens - width + np.arange(width)[:, None]
    return np.where(np.arange(width)[:, None] >= width - lens, buf[np.maximum(at, 0)], 0)


def crc8(buf, starts, lens) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint32)
    for column in _right_aligned(buf, starts, lens):
        crc = _CRC8[crc ^ column]
    return crc.astype(np.uint8)


def crc16(buf, starts, lens) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint32)
    for column in _right_aligned(buf, starts, lens):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ column]
    return crc.astype(np.uint16)


def _coded_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: a byte matrix and the lengths."""
    size = np.ones(len(n), np.int64)
    for limit in (0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000):
        size += n >= limit
    out = np.zeros((len(n), 7), np.uint8)
    for k in range(1, 8):
        rows = size == k
        if rows.any():
            for j in range(k - 1, 0, -1):
                out[rows, j] = 0x80 | ((n[rows] >> (6 * (k - 1 - j))) & 0x3F)
            lead = 0 if k == 1 else (0xFF00 >> k) & 0xFF
            out[rows, 0] = lead | (n[rows] >> (6 * (k - 1)))
    return out, size


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each row and the bits it takes."""
    n = z.shape[1]
    total = z.sum(1, dtype=np.int64)
    guess = np.clip(np.log2(np.maximum(total / n, 1e-9) * 0.6931).round(), 0, 13).astype(np.int32)
    best_k, best = guess, None
    for step in (0, 1):
        k = np.clip(guess + step, 0, 14)
        bits = n * (k.astype(np.int64) + 1) + (z >> k[:, None]).sum(1, dtype=np.int64)
        best_k = k if best is None else np.where(bits < best, k, best_k)
        best = bits if best is None else np.minimum(bits, best)
    return best_k, best


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantised order-2 predictor of every row, from its autocorrelation."""
    f = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, : BLOCK - k], f[:, k:]).astype(np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    ok = det > 1e-6 * r0 * r0
    det = np.where(ok, det, 1)
    a = np.stack([np.where(ok, (r1 * r0 - r1 * r2) / det, 0), np.where(ok, (r0 * r2 - r1 * r1) / det, 0)], 1)
    limit = (1 << (_LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << _LPC_SHIFT)), -limit, limit).astype(np.int32)


def encode(payload: np.ndarray, frames_of: np.ndarray) -> list[bytes]:
    """One stream per entry of ``frames_of``; ``payload`` holds all their samples (unsigned bytes), 576 a frame."""
    x = (payload.reshape(-1, BLOCK).astype(np.int32)) - 128
    n = len(x)
    number = np.arange(n) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    coef = _linear(x)
    residuals = {8: x, 9: np.diff(x, axis=1), 33: x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> _LPC_SHIFT)}
    choice, bits, rice = np.full(n, 1), np.full(n, 8 * BLOCK, np.int64), np.zeros(n, np.int32)
    for code, extra in ((8, 0), (9, 8), (33, 16 + 9 + 2 * _LPC_BITS)):
        k, b = _rice(_zigzag(residuals[code]))
        better = b + extra + 10 < bits
        choice[better], bits[better], rice[better] = code, (b + extra + 10)[better], k[better]
    flat = (x == x[:, :1]).all(1)
    choice[flat], bits[flat] = 0, 8

    numbers, number_size = _coded_numbers(number)
    head = 4 + number_size + 1
    size = head + 1 + (bits + 7) // 8 + 2
    start = np.cumsum(size) - size
    out_bits = np.zeros(int(size.sum()) * 8, np.uint8)
    body = (start + head + 1) * 8  # after the subframe's type byte
    for code, order in ((8, 0), (9, 1), (33, 2)):
        for k in range(15):
            rows = np.flatnonzero((choice == code) & (rice == k))
            if not len(rows):
                continue
            at = body[rows] + 8 * order
            if code == 33:
                fields = [(_LPC_BITS - 1, 4), (_LPC_SHIFT, 5), (coef[rows, 0], _LPC_BITS), (coef[rows, 1], _LPC_BITS)]
                for value, width in fields:
                    for j in range(width):
                        out_bits[at + j] = (value >> (width - 1 - j)) & 1
                    at = at + width
            for j in range(4):  # method 0, partition order 0, then the parameter
                out_bits[at + 6 + j] = (k >> (3 - j)) & 1
            z = _zigzag(residuals[code][rows])
            length = (z >> k) + (k + 1)
            pos = np.cumsum(length, axis=1, dtype=np.int64) + (at + 10)[:, None]
            out_bits[pos - k - 1] = 1
            for j in range(k):
                out_bits[pos - k + j] = (z >> (k - 1 - j)) & 1
    out = np.packbits(out_bits)
    for j in range(4):
        out[start + j] = _FRAME[j]
    for j in range(7):
        rows = number_size > j
        out[start[rows] + 4 + j] = numbers[rows, j]
    out[start + head - 1] = crc8(out, start, head - 1)
    out[start + head] = choice << 1
    raw = np.flatnonzero(choice == 1)
    out[(start[raw] + head[raw] + 1)[:, None] + np.arange(BLOCK)] = x[raw].astype(np.int8).view(np.uint8)
    for code, order in ((0, 1), (9, 1), (33, 2)):
        rows = np.flatnonzero(choice == code)
        for j in range(order):
            out[start[rows] + head[rows] + 1 + j] = x[rows, j].astype(np.int8).view(np.uint8)
    check = crc16(out, start, size - 2)
    out[start + size - 2], out[start + size - 1] = check >> 8, check & 0xFF

    streams, first = [], 0
    for count in frames_of:
        last = first + int(count)
        lo, hi = int(start[first]), int(start[last - 1] + size[last - 1])
        pcm = x[first:last].astype(np.int8).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(size[first:last].min()).to_bytes(3, "big") + int(size[first:last].max()).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm, usedforsecurity=False).digest()
        points = np.zeros(last - first, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        points["sample"], points["byte"], points["n"] = np.arange(last - first) * BLOCK, start[first:last] - lo, BLOCK
        table = points.tobytes()
        streams.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + out[lo:hi].tobytes())
        first = last
    return streams


class _Bits:
    """Big-endian bit reads at many places at once."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(buf) + 8, np.uint64)
        for j in range(8):
            self.words |= b[j : j + len(buf) + 8].astype(np.uint64) << np.uint64(56 - 8 * j)

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, width) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), pos.shape)
        return ((self.at(pos) >> np.uint64(1)) >> (63 - width).astype(np.uint64)).astype(np.int64)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Length of the run of zero bits from each place on."""
        top = self.at(pos) & np.uint64(0xFFFFFFFFFFFF0000)
        out = 64 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        far = np.flatnonzero(top == 0)
        if len(far):
            out[far] = 48 + self.zeros(pos[far] + 48)
        return out


def _signed(value: np.ndarray, width) -> np.ndarray:
    return np.where(value >> (width - 1) & 1, value - (1 << width), value)


def _frame_starts(data: bytes, first: int, frames: int) -> list[int]:
    """Frame places by sync code, frame number and header CRC."""
    starts, at = [], first
    for i in range(frames):
        code, size = _coded_numbers(np.array([i]))
        head = _FRAME + code[0, : size[0]].tobytes()
        head += bytes([int(crc8(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0])])
        at = data.index(head, at)
        starts.append(at)
        at += len(head)
    return starts


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each stream, its samples (unsigned bytes) and the sample offset of each frame; raises on any failed check."""
    starts, sizes, counts, sums = [], [], [], []
    base = 0
    for data in streams:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, None
        while not last:
            kind, last, n = data[at] & 0x7F, bool(data[at] & 0x80), int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                if block[:4] != BLOCK.to_bytes(2, "big") * 2 or (packed >> 36) & 0xFF != 7:
                    raise ValueError("only 8-bit mono streams in frames of 576 samples are read")
                total, md5 = packed & ((1 << 36) - 1), block[18:34]
            elif kind == 3:
                points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
            at += 4 + n
        frames = total // BLOCK
        if points is not None and len(points) == frames:
            own = points["byte"].astype(np.int64) + at
        else:
            own = np.array(_frame_starts(data, at, frames), np.int64)
        starts.append(own + base)
        sizes.append(np.diff(np.concatenate([own, [len(data)]])))
        counts.append(frames)
        sums.append(md5)
        base += len(data)
    buf = np.frombuffer(b"".join(streams), np.uint8)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    if (crc16(buf, start, size - 2) != (buf[start + size - 2].astype(np.uint16) << 8 | buf[start + size - 1])).any():
        raise ValueError("frame checksum mismatch")
    lead = buf[start + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    head = 4 + number_size
    if (crc8(buf, start, head) != buf[start + head]).any():
        raise ValueError("header checksum mismatch")
    x = _samples(buf, start + head + 1)
    out, first = [], 0
    for count, md5 in zip(counts, sums, strict=True):
        pcm = x[first : first + count].astype(np.int8)
        if hashlib.md5(pcm.tobytes(), usedforsecurity=False).digest() != md5:
            raise ValueError("stream checksum mismatch")
        out.append(((pcm.astype(np.int16) + 128).astype(np.uint8).ravel(), np.arange(count) * BLOCK))
        first += count
    return out


def _samples(buf: np.ndarray, subframe: np.ndarray) -> np.ndarray:
    kind = buf[subframe] >> 1
    if (buf[subframe] & 0x81).any():
        raise ValueError("wasted bits aren't read")
    x = np.zeros((len(subframe), BLOCK), np.int32)
    rows = np.flatnonzero(kind == 0)
    x[rows] = buf[subframe[rows] + 1].view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 1)
    x[rows] = buf[(subframe[rows] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    rows = np.flatnonzero(kind >= 8)
    if len(rows):
        x[rows] = _predicted(buf, _Bits(buf), subframe[rows] + 1, kind[rows].astype(np.int64))
    return x


def _predicted(buf: np.ndarray, bits: _Bits, warm: np.ndarray, kind: np.ndarray) -> np.ndarray:
    n = len(kind)
    order = np.where(kind >= 32, kind - 31, kind - 8)
    most = int(order.max())
    coef, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    for o in range(1, min(most, 4) + 1):
        rows = np.flatnonzero((kind < 32) & (order == o))
        coef[:o, rows] = np.array(_FIXED[o])[:, None]
    pos = (warm + order) * 8
    rows = np.flatnonzero(kind >= 32)
    if len(rows):
        width, p = bits.read(pos[rows], 4) + 1, pos[rows] + 9
        shift[rows] = bits.read(p - 5, 5)
        for j in range(int(order[rows].max())):
            live = order[rows] > j
            coef[j, rows[live]] = _signed(bits.read(p[live], width[live]), width[live])
            p[live] += width[live]
        pos[rows] = p
    method = bits.read(pos, 2)
    parts = np.int64(1) << bits.read(pos + 2, 4)
    wide = 4 + (method == 1)
    pos = pos + 6
    x = np.zeros((BLOCK + most, n), np.int64)  # a row per sample, after ``most`` zeros
    for j in range(most):
        live = order > j
        x[most + j, live] = buf[warm[live] + j].view(np.int8)
    k, raw, escaped = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    span = BLOCK // parts
    alike, first_order, any_parts = bool((order == order[0]).all()), int(order.min()), bool((parts > 1).any())
    for i in range(first_order, BLOCK):
        live = slice(None) if alike or i >= most else np.flatnonzero(order <= i)
        if i <= most or any_parts:
            opens = np.flatnonzero((order == i) | ((i % span == 0) & (i > order)))
            if len(opens):
                k[opens] = bits.read(pos[opens], wide[opens])
                pos[opens] += wide[opens]
                escaped[opens] = k[opens] == (1 << wide[opens]) - 1
                rows = opens[escaped[opens]]
                raw[rows] = bits.read(pos[rows], 5)
                pos[rows] += 5
        p, kk = pos[live], k[live]
        q = bits.zeros(p)
        p = p + q + 1
        z = (q << kk) | ((bits.at(p) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        p = p + kk
        r = (z >> 1) ^ -(z & 1)
        if escaped.any():
            e = escaped[live]
            from_, width = pos[live][e], raw[live][e]
            r[e] = np.where(width > 0, _signed(bits.read(from_, width), np.maximum(width, 1)), 0)
            p[e] = from_ + width
        pos[live] = p
        pred = np.zeros(n, np.int64)
        for j in range(most):
            pred += coef[j] * x[most + i - 1 - j]
        x[most + i, live] = r + (pred >> shift)[live]
    return x[most:].T
