"""Packing of token sequences into bins by swap-based local search.

Pieces of full length are bins by themselves. The others are dealt over groups of bounded size; in each, a
best-fit start is improved by exchanging one piece for one, two for one, or moving pieces between underfull
bins, each step increasing the sum of squared fills, until bins empty. Bins that stay underfull are opened
again and packed together with those of other groups, in ever fewer groups, so the groups cost no bins.

Defined cases: null and empty texts are the end id alone; rows that repeat a doc_id are packed separately; null
doc_ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, remove, table_path
from .tokens import encoder

#: Tokens of a bin, and pieces that one task packs.
CAPACITY = 4096
GROUP_PIECES = 60_000
#: Groups whose underfull bins are packed together in the next round.
MERGE = 16
MAX_TURNS = 12
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
_PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, slot long, open boolean"


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 36
        for batch in batches:
            for low, tokens, sizes in encoder(path).encode(batch.column("text"), end):
                ids = batch.column("doc_id")[low : low + len(sizes)]
                n = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                begin = (np.cumsum(sizes) - sizes)[owner] + start
                data = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(slot + np.arange(len(owner)))], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])
                slot += len(owner)

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, used = 0, 0  # rooms: bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        bins[i] = b
        if room - size:
            by_room.setdefault(room - size, []).append(b)
            rooms |= 1 << (room - size)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Improve a packing by moves and exchanges between underfull bins until every underfull bin was tried.

    A donor's piece moves into the fullest bin with room; else it is exchanged for one smaller piece, or for two
    that together are smaller, of a bin that thereby becomes fuller than before. Each step raises the sum of
    squared fills, for the receiving bin is at least as full as the donor.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths, minlength=int(bins.max(initial=-1)) + 1).astype(np.int64)
    live = np.flatnonzero((fill[bins] < capacity) & (fill[bins] > 0))
    size, home = lengths[live], bins[live]
    donors = [int(b) for b in np.argsort(fill, kind="stable") if 0 < fill[b] < capacity]
    free = capacity * len(donors) - int(fill[donors].sum())
    for donor in donors:
        if free < capacity:  # not enough in all to empty a bin
            break
        saved = (home.copy(), fill.copy())
        while (own := np.flatnonzero(home == donor)).size:
            x = int(own[np.argmax(size[own])])
            room = capacity - fill
            room[donor] = -1
            room[fill == 0] = -1
            takes = np.flatnonzero((room >= size[x]) & (fill >= fill[donor]))
            if takes.size:
                to = int(takes[np.argmin(room[takes])])
                home[x] = to
                fill[to] += size[x]
                fill[donor] -= size[x]
                continue
            gain = size[x] - size  # what bin home[y] gains from the exchange of y for x
            good = np.flatnonzero((gain > 0) & (gain <= room[home]) & (home != donor) & (fill[home] >= fill[donor]))
            if good.size:
                y = int(good[np.argmax(gain[good])])
                home[x], home[y] = home[y], donor
                fill[home[x]] += gain[y]
                fill[donor] -= gain[y]
                continue
            if not _two_for_one(x, donor, size, home, fill, room):
                break
        if fill[donor]:
            home, fill = saved if fill[donor] >= saved[1][donor] else (home, fill)
        else:
            free -= capacity
    bins[live] = home
    return bins


def _two_for_one(x: int, donor: int, size: np.ndarray, home: np.ndarray, fill: np.ndarray, room: np.ndarray) -> bool:
    """Exchange x for two pieces of one bin that are smaller together, where the bin has room for the rest."""
    small = np.flatnonzero((size < size[x]) & (home != donor) & (fill[home] >= fill[donor]) & (room[home] > 0))
    order = small[np.lexsort((size[small], home[small]))]
    if order.size < 2:
        return False
    # for each piece of a bin, the smallest later one that with it leaves no more than the bin's room: all pairs count
    span = int(size[x]) + 1
    key = home[order] * span + size[order]
    need = np.maximum(size[x] - room[home[order]] - size[order], 0)
    at = np.maximum(np.searchsorted(key, home[order] * span + need), np.arange(1, order.size + 1))
    a, b = order[at < order.size], order[at[at < order.size]]
    gain = size[x] - size[a] - size[b]
    good = np.flatnonzero((home[a] == home[b]) & (gain > 0))
    if not good.size:
        return False
    k = good[np.argmax(gain[good])]
    to = home[a[k]]
    home[x], home[a[k]], home[b[k]] = to, donor, donor
    fill[to] += gain[k]
    fill[donor] -= gain[k]
    return True


def _pack_group(capacity: int, last: bool, turn: int):
    def run(key, table):
        lengths = table.column("length").to_numpy()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        bins, lengths = bins[order], lengths[order]
        total = np.cumsum(lengths) - lengths
        first = np.concatenate([[True], bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, bool)
        offset = total - np.maximum.accumulate(np.where(first, total, 0))
        fill = np.bincount(bins, lengths, minlength=1).astype(np.int64)
        # the emptier half of what is underfull goes on, so that rounds end, at least the emptiest bin
        under = np.flatnonzero((fill < capacity) & (fill > 0))
        opened = np.zeros(len(fill), bool)
        if not last and under.size:
            opened[under[np.argsort(fill[under], kind="stable")][: max(1, under.size // 2)]] = True
        sequence = ((turn * (1 << 20) + key[0].as_py() + 1) << 24) + bins
        out = table.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, values in (("sequence_id", sequence), ("offset", offset)):
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        return out.append_column("slot", table.column("slot").take(pa.array(order))).append_column("open", pa.array(opened[bins]))

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text with its end id."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, end, capacity), _PIECES_DDL)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer, end, capacity), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # sequence numbers: a full piece has its slot, negative; a packed bin its round, group and place
    done = [pieces.where(F.col("length") == capacity).select(*names, (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, turn = pieces.where(F.col("length") < capacity), 0
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    while True:
        keyed = rest.select(*names, "slot", F.pmod(F.xxhash64("slot"), F.lit(groups)).alias("grp"))
        packed = materialise(keyed.groupBy("grp").applyInArrow(_pack_group(capacity, groups == 1 or turn >= MAX_TURNS, turn), _PACKED_DDL), "packed")
        done.append(packed.where("not open").select(*names, "sequence_id", "offset"))
        if groups == 1 or turn >= MAX_TURNS:
            break
        rest, turn = packed.where("open").select(*names, "slot"), turn + 1
        groups = max(1, min(groups - 1, -(-groups // MERGE)), -(-rest.count() // GROUP_PIECES))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
