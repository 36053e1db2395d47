"""FLAC streams of 8-bit mono samples as numpy array work: many frames of many streams at once.

A frame holds 576 samples. Each frame takes the cheapest of: one constant, the samples as they
are, a fixed predictor of order 0 to 2, or a linear predictor of order 4, the latter two with
Rice-coded residuals in four partitions. Streams have STREAMINFO (with the MD5 of the samples)
and a SEEKTABLE with a point for every frame, so that any block can be decoded on its own.
Decoding checks CRC-8 of every frame header, CRC-16 of every frame and each stream's MD5; what doesn't fit is a
ValueError. All loops run over bit
fields or sample positions within a frame, each step for all frames.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

FRAME, PARTS = 576, 4
PART = FRAME // PARTS
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 10, 7
HEAD = 1 + LPC_ORDER + 2 + LPC_ORDER + 1  # bit fields of a subframe before the residuals
LAST, RATE = 0x80, 8000
SHORTEST = 9  # bytes of a frame of one constant
MD5 = slice(26, 42)  # of STREAMINFO, the first block


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
LEAD = np.array([16, *(16 - int(x).bit_length() for x in range(1, 1 << 16))], np.uint8)  # leading zeros of 16 bits


def _crc(rows: np.ndarray, wide: bool) -> np.ndarray:
    """Of each row; rows are padded with zeros on the left, which leave the sum as it is."""
    crc = np.zeros(len(rows), np.uint16)
    for column in np.ascontiguousarray(rows.T):
        crc = (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ column] if wide else CRC8[(crc ^ column) & 255]
    return crc


def _right_aligned(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes start .. start+length of data as rows, zeros on the left."""
    most = int(length.max(initial=0))
    at = (start + length)[:, None] - np.arange(most, 0, -1)
    return np.where(at >= start[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 manner: rows of 6 bytes, zeros on the left, and their lengths."""
    size = 1 + np.searchsorted([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26], n, side="right")
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(6):
        low = (n >> (6 * k)) & 0x3F | 0x80
        first = (n >> (6 * k)) | ((0xFF00 >> size) & 0xFF)
        out[:, 5 - k] = np.where(k < size - 1, low, np.where((k == size - 1) & (size > 1), first, 0))
    out[:, 5] = np.where(size == 1, n, out[:, 5])
    return out, size


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of every frame by Levinson's recursion."""
    w = x.astype(np.float32) * np.hanning(FRAME).astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", w[:, lag:], w[:, : FRAME - lag]) for lag in range(LPC_ORDER + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), LPC_ORDER)), np.maximum(r[:, 0] * 1.000001, 1e-9)
    for m in range(LPC_ORDER):
        k = (r[:, m + 1] - np.einsum("ij,ij->i", a[:, :m], r[:, m:0:-1])) / err
        a[:, :m], a[:, m] = a[:, :m] - k[:, None] * a[:, :m][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most).astype(np.int32)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 576 samples (int32 in -128..127) with their frame numbers to the frames' bytes,
    one after the other, and each one's length."""
    n = len(x)
    q = _lpc(x)
    kinds = [x, np.diff(x, axis=1, prepend=0), np.diff(np.diff(x, axis=1, prepend=0), axis=1, prepend=0)]
    predicted = np.zeros_like(x)
    for i in range(LPC_ORDER):
        predicted[:, LPC_ORDER:] += q[:, i : i + 1] * x[:, LPC_ORDER - 1 - i : FRAME - 1 - i]
    kinds.append(x - (predicted >> LPC_SHIFT))
    orders = np.array([0, 1, 2, LPC_ORDER], np.int32)
    cost = np.stack([np.abs(e[:, o:]).mean(1) for e, o in zip(kinds, orders)], 1)
    best = cost.argmin(1)
    order = orders[best]
    e = np.choose(best[:, None], kinds)
    z = ((e << 1) ^ (e >> 31)).reshape(n, PARTS, PART)
    coded = np.arange(FRAME) >= order[:, None]
    z = np.where(coded.reshape(z.shape), z, 0)
    many = coded.reshape(z.shape).sum(2, dtype=np.int32)
    near = np.floor(np.log2(np.maximum(z.sum(2) / many, 1))).astype(np.int32)
    trial = np.stack([np.clip(near + np.int32(d), 0, 14) for d in (-1, 0, 1)])
    bits = np.stack([(z >> k[:, :, None]).sum(2, dtype=np.int32) + many * (k + 1) for k in trial])
    which = bits.argmin(0)
    k = np.take_along_axis(trial, which[None], 0)[0]
    total = 8 + 8 * order + np.where(best == 3, 9 + LPC_ORDER * LPC_BITS, 0) + 6 + (4 + np.take_along_axis(bits, which[None], 0)[0]).sum(1)
    raw, flat = total > 8 + 8 * FRAME, (x == x[:, :1]).all(1)
    plain = raw | flat
    lpc, zero = (best == 3) & ~plain, np.zeros(n, np.int64)

    # bit fields of every frame: value, its bits, and zeros before it
    fields = HEAD + PARTS * (1 + PART)
    value, width, zeros = (np.zeros((n, fields), np.int32) for _ in range(3))
    value[:, 0] = np.where(flat, 0, np.where(raw, 1, np.where(best == 3, 32 + LPC_ORDER - 1, 8 + order))) << 1
    width[:, 0] = 8
    for i in range(LPC_ORDER):
        value[:, 1 + i], width[:, 1 + i] = x[:, i] & 255, np.where((order > i) & ~plain, 8, 0)
        value[:, 3 + LPC_ORDER + i], width[:, 3 + LPC_ORDER + i] = q[:, i] & ((1 << LPC_BITS) - 1), np.where(lpc, LPC_BITS, 0)
    value[:, 1 + LPC_ORDER], width[:, 1 + LPC_ORDER] = LPC_BITS - 1, np.where(lpc, 4, 0)
    value[:, 2 + LPC_ORDER], width[:, 2 + LPC_ORDER] = LPC_SHIFT, np.where(lpc, 5, 0)
    value[:, HEAD - 1], width[:, HEAD - 1] = PARTS.bit_length() - 1, np.where(plain, 0, 6)
    body = (n, PARTS, 1 + PART)
    v, w, s = (a[:, HEAD:].reshape(body) for a in (value, width, zeros))
    v[:, :, 0], w[:, :, 0] = k, np.where(plain[:, None], 0, 4)
    sample = (x & 255).reshape(n, PARTS, PART)
    rice, own = (~plain)[:, None, None], k[:, :, None]
    v[:, :, 1:] = np.where(rice, (np.int32(1) << own) | (z & ((np.int32(1) << own) - 1)), sample)
    kept = np.where(plain[:, None], raw[:, None] | (np.arange(FRAME) == 0), coded).reshape(z.shape)
    w[:, :, 1:] = np.where(kept, np.where(rice, own + 1, 8), 0)
    s[:, :, 1:] = np.where(kept & rice, z >> own, 0)

    end = np.cumsum(width + zeros, axis=1, dtype=np.int32)
    names, name_size = _number_bytes(number)
    top = 4 + name_size + 1
    length = top + (end[:, -1] + 7) // 8 + 2
    start = np.cumsum(length) - length
    end = end + (8 * (start + top)).astype(np.int32)[:, None]
    used = width > 0
    last, val = end[used] - 1, value[used]
    val = val << (7 - (last & 7)).astype(np.int32)
    last >>= 3
    size = int(length.sum())
    out = np.bincount(last, val & 255, size)
    for up in (1, 2):
        part = (val >> (8 * up)) & 255
        some = part > 0
        out += np.bincount(last[some] - up, part[some], size)
    out = out.astype(np.uint8)
    for i, byte in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        out[start + i] = byte
    for i in range(6):
        has = i >= 6 - name_size
        out[(start + 4 + i - (6 - name_size))[has]] = names[has, i]
    out[start + top - 1] = _crc(_right_aligned(out, start, top - 1), False)
    crc = _crc(_right_aligned(out, start, length - 2), True)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 255
    return out, length


def stream_header(pcm: bytes, lengths: np.ndarray) -> bytes:
    """Everything before the frames; pcm: the samples as signed bytes."""
    n = len(lengths)
    info = struct.pack(">HH", FRAME, FRAME) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    points = np.zeros(n, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
    points["sample"], points["byte"], points["count"] = np.arange(n) * FRAME, np.cumsum(lengths) - lengths, FRAME
    # a block's length has 24 bits: more frames take more tables
    tables, most = b"", (1 << 24) // 18 - 1
    for i in range(0, n, most):
        part = points[i : i + most].tobytes()
        tables += bytes([3 | (LAST if i + most >= n else 0)]) + len(part).to_bytes(3, "big") + part
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + tables


def encode(payloads: list[bytes], frames_at_once: int = 1024) -> list[bytes]:
    """A stream for each payload of unsigned bytes, whose lengths are positive multiples of 576."""
    counts = [len(p) // FRAME for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    number = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    made = [encode_frames(x[i : i + frames_at_once].astype(np.int32) - 128, number[i : i + frames_at_once]) for i in range(0, len(x), frames_at_once)]
    if not made:
        return []
    data, lengths = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    signed = (x ^ 128).tobytes()
    out, at = [], 0
    for c in counts:
        out.append(stream_header(signed[at * FRAME : (at + c) * FRAME], lengths[at : at + c]) + data[ends[at] : ends[at + c]].tobytes())
        at += c
    return out


def seek_points(media: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of samples, and each frame's first byte and length in the stream."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found, samples = 4, False, [], 0
    while not last:
        if at + 4 > len(media) or at + 4 + int.from_bytes(media[at + 1 : at + 4], "big") > len(media):
            raise ValueError("the stream ends within its header")
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        last, block = kind & LAST, media[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            samples = int.from_bytes(block[10:18], "big") & ((1 << 36) - 1)
        elif kind & 127 == 3:
            if size % 18:
                raise ValueError("the seek table has no whole points")
            found.append(np.frombuffer(block, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")])))
        at += 4 + size
    points = np.concatenate(found) if found else np.zeros(0, [("byte", ">u8")])
    if len(points) * FRAME != samples:
        raise ValueError("the seek table must have a point for every frame")
    start = points["byte"].astype(np.int64) + at
    length = np.diff(np.append(start, len(media)))
    if len(start) == 0 or start[0] != at or (length < SHORTEST).any() or (points["sample"] != np.arange(len(points)) * FRAME).any():
        raise ValueError("the seek table's points are not the frames' places")
    return samples, start, length


class _Bits:
    """Reads bit fields at a place of its own in each frame."""

    def __init__(self, data: np.ndarray, place: np.ndarray):
        self.words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.place = place.astype(np.int64)

    def _ahead(self) -> np.ndarray:
        return self.words[self.place >> 3].astype(np.uint64) << (self.place & 7).astype(np.uint64)

    def take(self, bits: int) -> np.ndarray:
        got = (self._ahead() >> np.uint64(64 - bits)).astype(np.int64)
        self.place += bits
        return got

    def signed(self, bits: int) -> np.ndarray:
        got = self.take(bits)
        return got - ((got >> (bits - 1)) << bits)

    def rice(self, k: np.ndarray) -> np.ndarray:
        ahead = self._ahead()
        zeros = LEAD[(ahead >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        quotient = zeros
        if (zeros == 16).any():
            quotient, more = zeros.copy(), zeros == 16
            while more.any():
                self.place[more] += 16
                ahead = self._ahead()
                zeros = np.where(more, LEAD[(ahead >> np.uint64(48)).astype(np.int64)].astype(np.int64), zeros)
                quotient[more] += zeros[more]
                more = more & (zeros == 16)
        low = (ahead << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
        self.place += zeros + 1 + k
        got = (quotient << k) | low.astype(np.int64)
        return (got >> 1) ^ -(got & 1)


def _predicted(data: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
    """Samples (576 x frames) of subframes of one kind, whose fields begin at bit ``place``."""
    bits, order = _Bits(data, place), kind - 8 if kind < 32 else kind - 31
    x = np.zeros((FRAME, len(place)), np.int64)
    for i in range(order):
        x[i] = bits.signed(8)
    if kind >= 32:
        precision = bits.take(4) + 1
        if (precision != LPC_BITS).any():
            raise ValueError(f"linear predictors have {LPC_BITS} bits here")
        shift, q = bits.take(5), [bits.signed(LPC_BITS) for _ in range(order)]
    head = bits.take(6)
    if (head >> 4).any():
        raise ValueError("residuals are Rice-coded with 4-bit parameters here")
    part = FRAME >> (head & 15)
    k = np.zeros(len(place), np.int64)
    for t in range(FRAME):
        if t == order or t % 9 == 0:
            new = (t % part == 0) if t != order else np.full(len(place), True)
            if t < order:
                continue
            if new.all():
                k = bits.take(4)
            elif new.any():
                at = bits.place.copy()
                k = np.where(new, bits.take(4), k)
                bits.place = np.where(new, bits.place, at)
        if t < order:
            continue
        e = bits.rice(k)
        if kind >= 32:
            p = q[0] * x[t - 1]
            for i in range(1, order):
                p += q[i] * x[t - 1 - i]
            e += p >> shift
        elif order == 1:
            e += x[t - 1]
        elif order == 2:
            e += 2 * x[t - 1] - x[t - 2]
        elif order > 2:
            raise ValueError("fixed predictors have order 0 to 2 here")
        x[t] = e
    return x


def decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames x 576, int8) and subframe kinds of the frames at these bytes of data,
    which has 8 spare bytes at its end. Raises ValueError where a checksum is wrong."""
    first = data[start + 4]
    name = np.where(first < 0x80, 1, LEAD[(~first.astype(np.int64) & 0xFF) << 8].astype(np.int64))
    top = 4 + name + 1
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x20).any() or (data[start + 3] != 0x02).any():
        raise ValueError("frames hold 576 samples of 8 bits in one channel here")
    if _crc(_right_aligned(data, start, top), False).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    if _crc(_right_aligned(data, start, length), True).any():
        raise ValueError("a frame's CRC-16 is wrong")
    kind = (data[start + top] >> 1).astype(np.int64)
    out = np.zeros((len(start), FRAME), np.int8)
    for which in np.unique(kind):
        rows = np.flatnonzero(kind == which)
        at = (start + top + 1)[rows]
        if which == 0:
            out[rows] = data[at][:, None].view(np.int8)
        elif which == 1:
            out[rows] = data[at[:, None] + np.arange(FRAME)].view(np.int8)
        elif 8 <= which <= 12 or which >= 32:
            out[rows] = _predicted(data, at * 8, int(which)).T
        else:
            raise ValueError(f"unknown kind of subframe {which}")
    return out, kind


def decode(streams: list[bytes], frames_at_once: int = 2048) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each stream its samples as unsigned bytes, and its subframe kinds."""
    if not streams:
        return [], []
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    points = [seek_points(s) for s in streams]
    start = np.concatenate([p[1] + b for p, b in zip(points, base)])
    length = np.concatenate([p[2] for p in points])
    parts = [decode_frames(data, start[i : i + frames_at_once], length[i : i + frames_at_once]) for i in range(0, len(start), frames_at_once)]
    samples, kinds = np.concatenate([p[0] for p in parts]).view(np.uint8) ^ 128, np.concatenate([p[1] for p in parts])
    ends = np.cumsum([0, *(len(p[1]) for p in points)])
    for stream, a, b in zip(streams, ends, ends[1:]):
        if stream[MD5] != hashlib.md5((samples[a:b] ^ 128).tobytes()).digest():
            raise ValueError("a stream's MD5 is wrong")
    return [samples[a:b].reshape(-1) for a, b in zip(ends, ends[1:])], [kinds[a:b] for a, b in zip(ends, ends[1:])]
