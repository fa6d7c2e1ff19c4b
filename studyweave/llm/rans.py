"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block is independent of all others. Its tokens are dealt over LANES states that advance together, so one
numpy step codes LANES tokens; states live in [2^31, 2^63) and give off 32-bit words. Every CHECK_STEPS steps
the block keeps a checkpoint - the states and the place in the words - with the checksum of the tokens up to
the next one, so that a block can also be decoded piecewise and in parallel.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"SWRA"
VERSION = 1
LANES = 1024
CHECK_STEPS = 256
#: Frequencies of a table add up to 2^SCALE.
SCALE = 20
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
_S = np.uint64(SCALE)
_HEAD = struct.Struct("<4sHHIIQIII")  # magic, version, lanes, table id, documents, tokens, words, checkpoints, crc of the rest


@dataclass
class Table:
    """Quantised frequencies shared by all blocks of a data set."""

    freq: np.ndarray
    start: np.ndarray
    ident: int
    _symbol: np.ndarray | None = None

    @staticmethod
    def of(freq: np.ndarray) -> "Table":
        freq = freq.astype(np.uint64)
        start = np.cumsum(freq) - freq
        return Table(freq, start, zlib.crc32(freq.astype("<u4").tobytes()))

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies with sum 2^SCALE, at least 1 for every symbol that occurs."""
    total, size = int(counts.sum()), 1 << SCALE
    freq = np.zeros(len(counts), np.int64)
    if not total:
        freq[0] = size
        return freq
    used = counts > 0
    freq[used] = np.maximum(1, (counts[used].astype(np.float64) * size / total).astype(np.int64))
    gap = size - int(freq.sum())
    while gap:  # the largest take up the rounding; each pass moves at most half of a frequency
        largest = np.argsort(-freq, kind="stable")[: max(1, len(freq) // 64)]
        for s in largest:
            step = gap if gap > 0 else -min(-gap, int(freq[s]) // 2)
            freq[s] += step
            gap -= step
            if not gap:
                break
    return freq


def encode(tokens: np.ndarray, table: Table) -> tuple[int, np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(lanes, first states, checkpoints as (word place, crc, states), words) of one block's tokens."""
    n = len(tokens)
    lanes = max(1, min(LANES, n // 32))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    freq, start = table.freq[tokens], table.start[tokens]
    given: list[np.ndarray] = []
    marks = []
    emitted = 0
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            words = x[full].astype(np.uint32)
            x = np.where(full, x >> _U32, x)
            given.append(words)
            emitted += len(words)
        q = x // f
        state[: len(f)] = (q << _S) + (x - q * f) + c
        if t % CHECK_STEPS == 0:
            part = tokens[t * lanes : (t + CHECK_STEPS) * lanes]
            marks.append((emitted, zlib.crc32(part.astype("<u4").tobytes()), state.copy()))
    words = np.concatenate(given[::-1]) if given else np.zeros(0, np.uint32)
    return lanes, state, [(emitted - at, crc, s) for at, crc, s in reversed(marks)], words


def decode_steps(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """n tokens from the given states and words on."""
    lanes, out, at = len(state), np.empty(n, np.uint16), 0
    state = state.copy()
    symbol, mask = table.symbol, np.uint64((1 << SCALE) - 1)
    for low in range(0, n, lanes):
        x = state[: min(lanes, n - low)]
        slot = x & mask
        s = symbol[slot.astype(np.int64)]
        out[low : low + len(x)] = s
        x = table.freq[s] * (x >> _S) + slot - table.start[s]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << _U32) | words[at : at + len(need)]
            at += len(need)
        state[: len(x)] = x
    return out


def pack(tokens: np.ndarray, ids: np.ndarray, absent: np.ndarray, lengths: np.ndarray, table: Table) -> bytes:
    """One block of the file format: documents' ids and lengths, states, checkpoints and words."""
    lanes, state, marks, words = encode(tokens, table)
    body = b"".join([ids.astype("<i8").tobytes(), absent.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), *(struct.pack("<II", at, crc) + s.astype("<u8").tobytes() for at, crc, s in marks), words.astype("<u4").tobytes()])
    return _HEAD.pack(MAGIC, VERSION, lanes, table.ident, len(ids), len(tokens), len(words), len(marks), zlib.crc32(body)) + body


class Block:
    """A block read back; checks its body on opening and each piece's tokens on decoding."""

    def __init__(self, raw: bytes, table: Table):
        magic, version, self.lanes, ident, docs, self.n, n_words, n_marks, crc = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION or ident != table.ident:
            raise ValueError("not a block of this table and version")
        if zlib.crc32(memoryview(raw)[_HEAD.size :]) != crc:
            raise ValueError("the block's checksum differs")
        at, self.table = _HEAD.size, table
        self.ids = np.frombuffer(raw, "<i8", docs, at)
        self.absent = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        self.marks = []
        for _ in range(n_marks):
            place, check = struct.unpack_from("<II", raw, at)
            self.marks.append((place, check, np.frombuffer(raw, "<u8", self.lanes, at + 8).astype(np.uint64)))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(raw, "<u4", n_words, at)

    def piece(self, k: int) -> np.ndarray:
        """Tokens between checkpoint k and the next one."""
        place, check, state = self.marks[k]
        span = CHECK_STEPS * self.lanes
        out = decode_steps(state, self.words[place:], min(span, self.n - k * span), self.table)
        if zlib.crc32(out.astype("<u4").tobytes()) != check:
            raise ValueError("a piece's checksum differs")
        return out

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.piece(k) for k in range(len(self.marks))] or [np.zeros(0, np.uint16)])
