"""Substring dedup by prefix-partitioned suffix trees over words.

Every word position that has ``width`` words left is a suffix. A suffix is known by its path: a code for its first
word, for its first two, three and four words, and one for all ``width`` - the order of these paths is the depth-first
order of a suffix tree cut off at ``width`` words. Sampled paths, each cut to the fewest words that tell it from the
one before, are the variable-length prefixes that split all suffixes into groups of a memory's size. A task sends each
path once, for the smallest document that it met there. One task builds the subtree of a group: sorted paths, whose
common prefixes are its nodes. The leaves below a node as deep as ``width`` words are a repeat; all but those of the
smallest document are marked. Marked suffixes that follow each other in a document make up its maximal repeats.

A path has 80 bits: 32 of the first words and 48 of all. Two different windows are mistaken for each other with a
probability of 2^-80, or 2^-48 if their first four words are the same: about 1e-5 for a thousand million words.

Defined cases: null and empty texts have no words; windows are those of the input, whatever is removed; rows that
repeat a doc_id are one document in the order, so they never remove from each other; rows without doc_id take no part
and keep all words; other columns are ignored and kept by :func:`drop_repeats`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, free_name, hand_back, materialise, maybe_broadcast, partitions, remove, table_path, text_buffers
from .shingles import mix
from .words import hashes, pack, unpack

#: Words of a window.
WIDTH = 13
#: Suffixes that a task sorts before it sends them, and suffixes of a subtree.
BLOCK = 1_000_000
GROUP = 500_000
#: Bytes of text hashed at once, and bytes of the texts from which splitters are sampled.
SLICE_BYTES = 1_000_000
SAMPLE_BYTES = 16_000_000
#: Bits of a path that the first one, two, three and four words decide.
_LEVELS = (12, 20, 26, 32)
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_SENT = "grp int, n int, marked int, docs int, path binary, rest binary, leaf_row binary, leaf_pos binary, mark_row binary, mark_pos binary, ids binary, texts binary"
_MARKS = "bucket int, n int, docs int, mark_row binary, mark_pos binary, ids binary, texts binary"
_SPANS = "span_id long, span_text long, first binary, lengths binary"


def paths(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of all suffixes of at least ``width`` words: 64 bits in tree order, and 16 more of the whole window."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    total, path, had = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0
    for k in range(width):
        total += words[k : k + n] * _PLACE[k % len(_PLACE)] + _PLACE[(k * 7) % len(_PLACE)]
        if k < min(len(_LEVELS), width - 1):
            bits = _LEVELS[k] - had
            path |= (mix(total + np.uint64(k)) >> np.uint64(64 - bits)) << np.uint64(64 - _LEVELS[k])
            had = _LEVELS[k]
    total = mix(total)
    return path | (total >> np.uint64(had)), (total & np.uint64(0xFFFF)).astype(np.uint16)


def _suffixes(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(path, rest, row, position) of the suffixes of slices of a batch of texts."""
    data, offsets = text_buffers(batch.column("text"))
    for low, high in byte_slices(offsets, SLICE_BYTES):
        words, _, _, owner = hashes(data[offsets[low] : offsets[high]], offsets[low:high] - offsets[low])
        path, rest = paths(words, width)
        if not len(path):
            continue
        begin = np.searchsorted(owner, np.arange(high - low))
        whole = owner[: len(path)] == owner[width - 1 :]
        row = owner[: len(path)][whole]
        yield path[whole], rest[whole], row + low, np.flatnonzero(whole) - begin[row]


def _sampler(width: int, thin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rest, _, _ in _suffixes(batch, width):
                got = path[mix(path ^ rest) % np.uint64(thin) == 0]
                yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["paths"])

    return run


def splitters(sampled: np.ndarray, groups: int) -> np.ndarray:
    """Borders of ``groups`` parts of about the same size; each is cut to the fewest words that still tell it apart."""
    sampled = np.sort(sampled)
    out: list[int] = []
    before = 0
    for k in range(1, groups):
        if not len(sampled):
            break
        at = int(sampled[len(sampled) * k // groups])
        for bits in (*_LEVELS, 64):
            border = at >> (64 - bits) << (64 - bits)
            if border > before:
                out.append(border)
                before = border
                break
    return np.array(out, np.uint64)


def _runs(path: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the paths, and the places in it where a new one begins: the leaves of the tree's nodes of full depth."""
    order = np.argsort(path, kind="stable")
    p, r = path[order], rest[order]
    if ((p[1:] == p[:-1]) & (r[1:] != r[:-1])).any():
        order = np.lexsort((rest, path))
        p, r = path[order], rest[order]
    return order, np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])]))


def _rows_of(row: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows numbered anew among those that occur, with their ids and text hashes."""
    used, new = np.unique(row, return_inverse=True)
    return new.astype(np.uint32), ids[used], texts[used]


class _Block:
    """Suffixes that a task gathers and sends, group by group."""

    def __init__(self, borders: np.ndarray):
        self.borders = borders
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []
        self.rows = self.n = 0

    def send(self) -> pa.RecordBatch | None:
        if not self.n:
            self.clear()
            return None
        path, rest, row, pos = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        ids, texts = np.concatenate(self.ids), np.concatenate(self.texts)
        self.clear()
        order, starts = _runs(path, rest)
        path, rest, row, pos = path[order], rest[order], row[order], pos[order]
        node = np.zeros(len(path), np.int64)
        node[starts[1:]] = 1
        node = np.cumsum(node)
        own = ids[row]
        later = own > np.minimum.reduceat(own, starts)[node]
        # of a document's places on one path the first is enough: the others are found again in its text
        first = np.ones(len(path), bool)
        first[1:] = (node[1:] != node[:-1]) | (row[1:] != row[:-1])
        leaf, later = first & ~later, first & later
        group = np.searchsorted(self.borders, path, side="right")
        cuts = np.searchsorted(group, np.arange(len(self.borders) + 2))
        out = []
        for g in np.unique(group).tolist():
            part = slice(cuts[g], cuts[g + 1])
            a, b = leaf[part], later[part]
            who, sent_ids, sent_texts = _rows_of(np.concatenate([row[part][a], row[part][b]]), ids, texts)
            k = int(a.sum())
            out.append((g, k, int(b.sum()), len(sent_ids), pack(path[part][a], True), pack(rest[part][a]), pack(who[:k]), pack(pos[part][a].astype(np.uint32)), pack(who[k:]), pack(pos[part][b].astype(np.uint32)), pack(sent_ids), pack(sent_texts)))
        return _batch(out, _SENT)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(names)], [n for n, _ in names])


def _sender(width: int, borders: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(borders)
        for batch in batches:
            block.ids.append(batch.column("doc_id").to_numpy())
            block.texts.append(batch.column("text_hash").to_numpy())
            base, block.rows = block.rows, block.rows + batch.num_rows
            for path, rest, row, pos in _suffixes(batch, width):
                block.parts.append((path, rest, (row + base).astype(np.int32), pos.astype(np.int32)))
                block.n += len(path)
            if block.n >= BLOCK:
                yield block.send()
            hand_back()
        if (last := block.send()) is not None:
            yield last

    return run


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a sorted partition, one key after the other."""
    held, now = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r[key] != now and held:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


class _Marks:
    """Marked places of a task's groups, dealt over buckets of documents once there are many of them."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, ids, texts = _rows_of(row, ids, texts)
        self.parts.append((row, pos.astype(np.uint32), ids, texts))
        self.n += len(row)
        if self.n >= BLOCK:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        base = np.cumsum([0] + [len(p[2]) for p in self.parts])
        row = np.concatenate([p[0].astype(np.int64) + b for p, b in zip(self.parts, base)])
        pos, ids, texts = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
        self.parts, self.n = [], 0
        deal = (mix(texts.view(np.uint64) ^ ids.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32)[row]
        order = np.argsort(deal, kind="stable")
        deal, row, pos = deal[order], row[order], pos[order]
        out = []
        for b in np.unique(deal).tolist():
            part = slice(*np.searchsorted(deal, [b, b + 1]))
            who, own_ids, own_texts = _rows_of(row[part], ids, texts)
            out.append((b, len(who), len(own_ids), pack(who), pack(pos[part]), pack(own_ids), pack(own_texts)))
        yield _batch(out, _MARKS)


def _subtrees(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(buckets)
        for _, sent in _by_key(batches, "grp"):
            path, rest, row, pos, marked_row, marked_pos, ids, texts = ([] for _ in range(8))
            base = 0
            for r in sent:
                path.append(unpack(r["path"], r["n"], np.uint64, True))
                rest.append(unpack(r["rest"], r["n"], np.uint16))
                row.append(unpack(r["leaf_row"], r["n"], np.uint32) + base)
                pos.append(unpack(r["leaf_pos"], r["n"], np.uint32))
                marked_row.append(unpack(r["mark_row"], r["marked"], np.uint32) + base)
                marked_pos.append(unpack(r["mark_pos"], r["marked"], np.uint32))
                ids.append(unpack(r["ids"], r["docs"], np.int64))
                texts.append(unpack(r["texts"], r["docs"], np.int64))
                base += r["docs"]
            path, rest, row, pos, marked_row, marked_pos, ids, texts = map(np.concatenate, (path, rest, row, pos, marked_row, marked_pos, ids, texts))
            if len(path):
                order, starts = _runs(path, rest)
                deep = np.diff(np.concatenate([starts, [len(path)]])) > 1  # nodes of full depth with several leaves
                own = ids[row[order]]
                least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.concatenate([starts, [len(path)]])))
                later = np.repeat(deep, np.diff(np.concatenate([starts, [len(path)]]))) & (own > least)
                marked_row = np.concatenate([marked_row, row[order][later]])
                marked_pos = np.concatenate([marked_pos, pos[order][later]])
            if len(marked_row):
                yield from marks.add(marked_row.astype(np.int64), marked_pos, ids, texts)
            hand_back()
        yield from marks.send()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked places of each document as runs."""
    for _, sent in _by_key(batches, "bucket"):
        ids, texts = (np.concatenate([unpack(r[c], r["docs"], np.int64) for r in sent]) for c in ("ids", "texts"))
        base = np.cumsum([0] + [r["docs"] for r in sent])
        row = np.concatenate([unpack(r["mark_row"], r["n"], np.uint32).astype(np.int64) + b for r, b in zip(sent, base)])
        pos = np.concatenate([unpack(r["mark_pos"], r["n"], np.uint32).astype(np.int64) for r in sent])
        pairs, number = np.unique(np.stack([ids, texts]), axis=1, return_inverse=True)
        place = np.unique((number.reshape(-1)[row] << 40) | pos)
        first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
        length = np.diff(np.concatenate([first, [len(place)]]))
        doc, start = place[first] >> 40, place[first] & ((1 << 40) - 1)
        cuts = np.searchsorted(doc, np.arange(pairs.shape[1] + 1))
        out = [(int(pairs[0, d]), int(pairs[1, d]), start[cuts[d] : cuts[d + 1]].astype("<u4").tobytes(), length[cuts[d] : cuts[d + 1]].astype("<u4").tobytes()) for d in range(pairs.shape[1])]
        yield _batch(out, _SPANS)
        hand_back()


def marked_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(span_id, span_text, first, lengths): runs of windows that also start in a document with a smaller doc_id.

    ``span_text`` is the hash of the row's text; of several equal windows in one document only the first is listed.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4 * partitions(spark), size // 6 // GROUP)
    part = min(1.0, SAMPLE_BYTES / max(size, 1))
    thin = max(1, int(size * part / 6 / (400 * groups)))
    sample = (rows if part == 1 else rows.sample(part, 1)).select("text").mapInArrow(_sampler(width, thin), "paths binary").collect()
    borders = splitters(np.frombuffer(b"".join(r.paths for r in sample), np.uint64), groups)
    sent = rows.mapInArrow(_sender(width, borders), _SENT).repartition(partitions(spark), "grp").sortWithinPartitions("grp")
    marks = sent.mapInArrow(_subtrees(2 * partitions(spark)), _MARKS).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return materialise(marks.mapInArrow(_gather, _SPANS), "repeats")


def _covered(text: bytes, first: np.ndarray, lengths: np.ndarray, width: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them marked windows cover."""
    words = text.split()  # at the white space of the contract
    data = np.frombuffer(text, np.uint8)
    path, rest = paths(hashes(data, np.zeros(1, np.int64))[0], width)
    at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    # windows that occur several times in this text are listed once
    key = np.empty(len(path), [("p", np.uint64), ("r", np.uint16)])
    key["p"], key["r"] = path, rest
    _, number = np.unique(key, return_inverse=True)
    listed = np.zeros(int(number.max()) + 1, bool)
    listed[number[at]] = True
    at = np.flatnonzero(listed[number])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return words, np.cumsum(edge[:-1]) > 0


def _cutter(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, out = [], [], []
            spans, lengths = batch.column("first"), batch.column("lengths")
            for k, text in enumerate(batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if spans[k].is_valid:
                    words, gone = _covered(raw, *(np.frombuffer(c[k].as_py(), "<u4").astype(np.int64) for c in (spans, lengths)), width)
                    kept = b" ".join(compress(words, ~gone))
                    lost = int(gone.sum())
                else:
                    words, lost = raw.split(), 0
                    kept = b" ".join(words)
                n.append(len(words))
                removed.append(lost)
                out.append((kept.decode() if lost else text.as_py()) if texts else hashlib.sha256(kept).hexdigest())
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "first", "lengths")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], [c for c in batch.schema.names if c not in ("text", "first", "lengths")] + ["n_words", "n_removed", "out"])
            hand_back()

    return run


def _with_spans(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text and the marked windows of each row; a number for the row's hash is left out again."""
    spans = marked_windows(docs, width)
    rows, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.length("first")), F.lit(0))).first()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    joined = keyed.join(maybe_broadcast(spans, rows, 40 + 2 * size / max(rows, 1)), (F.col("doc_id") == F.col("span_id")) & (F.col("text_hash") == F.col("span_text")), "left")
    return joined.select("doc_id", "text", "text_hash", "first", "lengths")


def find_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_sha256 of the kept words joined by one space."""
    rows = _with_spans(docs, width).select("doc_id", "text", "first", "lengths")
    cut = rows.mapInArrow(_cutter(width, False), "doc_id long, n_words long, n_removed long, out string")
    return cut.withColumnRenamed("out", "kept_sha256")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows with all columns; texts that lose words are their kept words joined by one space, others stay as they are."""
    spans = marked_windows(docs, width)
    rows, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.length("first")), F.lit(0))).first()
    first, lengths, span_id, span_text = (free_name(docs, c) for c in ("first", "lengths", "span_id", "span_text"))
    spans = spans.toDF(span_id, span_text, first, lengths)
    joined = docs.join(maybe_broadcast(spans, rows, 40 + 2 * size / max(rows, 1)), (docs["doc_id"].cast("long") == F.col(span_id)) & (F.xxhash64(docs["text"]) == F.col(span_text)), "left")

    @F.pandas_udf("string")
    def kept(text, firsts, counts):
        def one(t, f, c):
            words, gone = _covered(t.encode(), np.frombuffer(f, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64), width)
            return b" ".join(compress(words, ~gone)).decode()

        return text.where(firsts.isna(), [None if f is None else one(t, f, c) for t, f, c in zip(text, firsts, counts)])

    return joined.withColumn("text", F.when(F.col(first).isNull(), F.col("text")).otherwise(kept("text", first, lengths))).select(*docs.columns)
