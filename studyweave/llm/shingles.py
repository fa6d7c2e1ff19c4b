"""Word-shingle sets of texts as 63-bit hashes, computed on whole Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np

from .common import byte_slices

#: Bytes of text whose shingles are made at once, and bytes hashed at once (more only for a longer word); they
#: bound a worker's memory to about 20 and 60 times this.
SLICE_BYTES = 1_000_000
HASH_BYTES = 250_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in ((0, _P), (1, _P_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and each word's text; A-Z count as a-z."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low = 0
    while low < len(data):
        high = _cut(data, low)
        part, at = _hashed(data[low:high], bounds[(bounds >= low) & (bounds < high)] - low)
        hashes.append(part)
        starts.append(at + low)
        low = high
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(bounds, starts, side="right") - 1


def _cut(data: np.ndarray, low: int) -> int:
    """End of the next piece to hash: after the first white space from HASH_BYTES on, or the end."""
    at = low + HASH_BYTES
    while at < len(data):
        gaps = np.flatnonzero(~_WORD[data[at : at + HASH_BYTES]])
        if len(gaps):
            return at + int(gaps[0]) + 1
        at += HASH_BYTES
    return len(data)


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; texts begin at ``bounds``. A word's hash doesn't depend on its place."""
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[bounds <= len(data)]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _P)
    return hashes, starts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Yield (first row, counts, values) per slice of texts.

    ``values`` holds, text after text, each text's distinct shingle hashes in ascending order; ``counts`` how
    many each text has. A text of fewer than ``width`` words has its whole sequence as the only shingle; a
    text without words has none.
    """
    for low, high in byte_slices(offsets, SLICE_BYTES):
        part = data[offsets[low] : offsets[high]]
        bounds = offsets[low : high + 1] - offsets[low]
        rows = high - low
        words, owner = _words(part, bounds[:-1])
        if len(words) == 0:
            yield low, np.zeros(rows, np.int64), np.zeros(0, np.int64)
            continue
        per_text = np.bincount(owner, minlength=rows)
        begin = np.concatenate([[0], np.cumsum(per_text)[:-1]])
        place = np.concatenate([_PLACE, mix(np.arange(9, 9 + width, dtype=np.uint64))]) | np.uint64(1)
        last = len(words) - width + 1
        if last > 0:
            full = np.zeros(last, np.uint64)
            for k in range(width):
                full += words[k : k + last] * place[k]
            keep = owner[:last] == owner[width - 1 :]
            values, texts = full[keep], owner[:last][keep]
        else:
            values, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((per_text > 0) & (per_text < width))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                has = per_text[short] > k
                whole[has] += words[begin[short[has]] + k] * place[k]
            values = np.concatenate([values, whole + per_text[short].astype(np.uint64) * _P])
            texts = np.concatenate([texts, short])
        values = (mix(values) >> np.uint64(1)).astype(np.int64)
        order = np.lexsort((values, texts))
        values, texts = values[order], texts[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
        values, texts = values[new], texts[new]
        yield low, np.bincount(texts, minlength=rows), values
