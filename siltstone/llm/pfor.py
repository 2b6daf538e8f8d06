"""Patched frame-of-reference coding of unsigned 32-bit integers, as one byte string.

Layout, little-endian: `PFR1`, u32 block length, u64 number of values, u32 number of blocks, then one u32 a
block and one more: byte offsets from the end of this table (the index of block starts), then the blocks.
A block: u32 minimum, u8 width, u16 number of exceptions, the residuals' low `width` bits (64 values in
`width` 64-bit words), one u16 position and one u32 high part an exception.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
PERCENTILE = 90
_HEAD = struct.Struct("<4sIQI")
_BLOCK = struct.Struct("<IBH")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(m, 64) values below 2**width as (m, width) words."""
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64 if width else 0):
        k, s = divmod(j * width, 64)
        out[:, k] |= v[:, j] << np.uint64(s)
        if s + width > 64:
            out[:, k + 1] |= v[:, j] >> np.uint64(64 - s)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        k, s = divmod(j * width, 64)
        v = words[:, k] >> np.uint64(s)
        if s + width > 64:
            v = v | (words[:, k + 1] << np.uint64(64 - s))
        out[:, j] = v & mask
    return out


def encode(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Bytes of the values; block must be a multiple of 64, up to 65536."""
    values = np.ascontiguousarray(values, dtype=np.uint32)
    n, m = len(values), -(-len(values) // block)
    if not n:
        return _HEAD.pack(b"PFR1", block, 0, 0) + struct.pack("<I", 0)
    padded = np.full(m * block, values[-1], np.uint64)
    padded[:n] = values
    rows = padded.reshape(m, block)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = min(block - 1, int(block * percentile / 100))
    widths = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(int)
    bodies: list[bytes] = [b""] * m
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        r = rest[own]
        packed = _pack((r & np.uint64((1 << int(w)) - 1)).reshape(-1, 64), int(w)).reshape(len(own), -1)
        high = r >> np.uint64(w)
        counts = np.count_nonzero(high, axis=1)
        at_row, at_col = np.nonzero(high)
        ends = np.cumsum(counts)
        positions, highs = at_col.astype("<u2"), high[at_row, at_col].astype("<u4")
        for i, b in enumerate(own.tolist()):
            e = slice(ends[i] - counts[i], ends[i])
            bodies[b] = _BLOCK.pack(int(low[b]), int(w), int(counts[i])) + packed[i].tobytes() + positions[e].tobytes() + highs[e].tobytes()
    starts = np.cumsum([0, *map(len, bodies)]).astype("<u4")
    return b"".join([_HEAD.pack(b"PFR1", block, n, m), starts.tobytes(), *bodies])


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first to last (excluded; None: all). Only these blocks' bytes are looked at."""
    magic, block, n, m = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 string")
    last = m if last is None else min(last, m)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u4", m + 1, _HEAD.size)
    base = _HEAD.size + 4 * (m + 1)
    heads = [_BLOCK.unpack_from(data, base + int(starts[b])) for b in range(first, last)]
    out = np.zeros((last - first, block), np.uint64)
    by_width: dict[int, list[int]] = {}
    for i, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(i)
    for w, own in by_width.items():
        size = block // 64 * w * 8
        parts = []
        for i in own:
            at = base + int(starts[first + i]) + _BLOCK.size
            parts.append(data[at : at + size])
        out[own] = _unpack(np.frombuffer(b"".join(parts), "<u8").reshape(-1, w) if w else np.zeros((len(own) * block // 64, 0), np.uint64), w).reshape(len(own), block)
    for i, (low, w, k) in enumerate(heads):
        if k:
            at = base + int(starts[first + i]) + _BLOCK.size + block // 64 * w * 8
            where = np.frombuffer(data, "<u2", k, at)
            out[i, where] |= np.frombuffer(data, "<u4", k, at + 2 * k).astype(np.uint64) << np.uint64(w)
        out[i] += np.uint64(low)
    flat = out.reshape(-1)[: n - first * block]
    return flat.astype(np.uint32)
