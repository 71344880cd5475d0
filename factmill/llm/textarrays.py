"""Texts as flat byte arrays: words, rolling hashes and minima without a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once: some 15 arrays of 8 bytes a character live beside them.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for every byte, the same in each process.
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=U64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK_BYTES + 1024), base, dtype=U64)
        out[0] = 1
        have = np.cumprod(out, dtype=U64)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, and where each row begins and ends; a null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    size = np.diff(at)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count and size[(gone := ~np.asarray(column.is_valid()))].any():
        raw = np.concatenate([raw[a:b] for a, b, g in zip(at[:-1], at[1:], gone, strict=True) if not g] or [raw[:0]])
        return raw, np.concatenate(([0], np.cumsum(np.where(gone, 0, size))))
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `most` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch: see stretch_hash."""
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end); equal stretches have equal ones wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start] + (end - start).astype(U64))


def rolling_hash(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each position on."""
    if len(raw) < k:
        return np.zeros(0, U64)
    sums = prefix_hash(raw)
    h = sums[k:] - sums[:-k]
    h *= _powers(_INVERSE, len(h))
    return mix(h)


def sequence_hash(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k 64-bit items from each position on."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = mix(out * U64(_BASE) + items[j : j + n])
    return out


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each position on."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches where `inside` holds, none across a row's end, and each one's row."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as `width` little-endian bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)
