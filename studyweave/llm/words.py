"""Words of texts as 64-bit hashes with their places, and packed columns of numbers; whole Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import _power_tables, mix

#: Bytes hashed at once (more only for a longer word); bounds a worker's memory to about 60 times this.
HASH_BYTES = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the given inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACES = table((0x20, 0x20), (0x09, 0x0D))
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def hashes(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACES, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text) of the words of consecutive texts, which begin at ``bounds``.

    Words are runs of bytes outside ``gap``; ``fold`` maps bytes before they are hashed.
    """
    out: list[tuple] = []
    low = 0
    while low < len(data):
        high = _cut(data, low, gap)
        h, s, e = _hash_part(data[low:high], bounds[(bounds >= low) & (bounds < high)] - low, gap, fold)
        out.append((h, s + low, e + low))
        low = high
    h, s, e = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3))
    return h, s, e, np.searchsorted(bounds, s, side="right") - 1


def _cut(data: np.ndarray, low: int, gap: np.ndarray) -> int:
    """End of the next part: behind the first gap from HASH_BYTES on."""
    at = low + HASH_BYTES
    while at < len(data):
        gaps = np.flatnonzero(gap[data[at : at + HASH_BYTES]])
        if len(gaps):
            return at + int(gaps[0]) + 1
        at += HASH_BYTES
    return len(data)


def _hash_part(data: np.ndarray, firsts: np.ndarray, gap: np.ndarray, fold: np.ndarray):
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap[data]
    new = np.zeros(len(data) + 1, bool)
    new[firsts] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | new))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | new))
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP), starts, ends


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed byte planes; a rising column as its steps."""
    if not len(values):
        return b""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, dtype, rising: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8).reshape(dtype.itemsize, n)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
    return np.cumsum(values, dtype=dtype) if rising else values
