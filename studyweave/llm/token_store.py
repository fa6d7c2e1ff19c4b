"""Token ids of all documents in one range-ANS data set, in ascending doc_id order.

Documents are range-partitioned and sorted by doc_id, tokenised once, and kept as raw ids in the shared folder;
the counts of all ids (at most one row per vocabulary entry) give the one frequency table. Each sorted file is
then coded into independent blocks, which are written as a table of one row per block with the payload of
:mod:`rans` (header, documents, checkpoints, checksums, words). Readers decode blocks, or pieces of blocks, in
parallel. A file's first token number is the sum over the files before it, a table of one row per file.

Defined cases: null text is empty and encodes to the end id alone; null doc_ids come first and stay null; rows
that repeat a doc_id stay separate, next to each other in any order; an empty table gives an empty data set;
ids must be below 65,536 (the vocabulary's size is checked).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import rans
from .common import bound_batches, materialise, maybe_broadcast, partitions, remove, shared_path
from .tokens import encoder

#: Words kept by a worker that tokenises, and bytes it encodes at once.
CACHE_WORDS = 300_000
SLICE_BYTES = 4_000_000
#: A block is closed by the document that takes it to so many tokens.
BLOCK_TOKENS = 1 << 20
_RAW_DDL = "part int, doc_id long, first_token long, ids binary, token int, times long"
_RAW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first_token", pa.int64()), ("ids", pa.binary()), ("token", pa.int32()), ("times", pa.int64())])
_BLOCKS_DDL = "part int, first_token long, n_docs int, n_tokens long, payload binary"
_BLOCKS = pa.schema([("part", pa.int32()), ("first_token", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_DOCS_DDL = "part int, doc_id long, first_token long, n_tokens long, ids_crc32 long"


@dataclass
class TokenStore:
    """A written data set: the folder of its blocks and the shared frequency table."""

    path: str
    freq: np.ndarray

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_BLOCKS_DDL).parquet(self.path)


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, first = TaskContext.get().partitionId(), np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for low, tokens, sizes in encoder(path, CACHE_WORDS, SLICE_BYTES).encode(batch.column("text"), end):
                total += np.bincount(tokens, minlength=1 << 16)
                offsets = np.concatenate([[0], np.cumsum(sizes * 2)]).astype(np.int32)
                n = len(sizes)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])
                starts = first + np.cumsum(sizes) - sizes
                first += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column("doc_id")[low : low + n], pa.array(starts), ids, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], schema=_RAW)
        used = np.flatnonzero(total)
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(used.astype(np.int32)), pa.array(total[used])], schema=_RAW)

    return run


def _coded(freq: np.ndarray):
    """Blocks of neighbouring rows of one sorted file; each row knows its first token, so files may be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(freq)
        part, first, size, ids, held = None, 0, 0, [], []

        def close():
            nonlocal ids, held, size
            absent = np.array([x is None for x in ids])
            raw = rans.pack(np.concatenate(held), np.array([0 if x is None else x for x in ids], np.int64), absent, np.array([len(x) for x in held]), table)
            row = [[part], [first], [len(ids)], [size], [raw]]
            size, ids, held = 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _BLOCKS.types)], schema=_BLOCKS)

        for batch in batches:
            raw = batch.column("ids")
            for i, (p, doc, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "first_token")))):
                if ids and (p != part or at != first + size):
                    yield close()
                if not ids:
                    part, first = p, at
                tokens = np.frombuffer(raw[i].as_buffer(), np.uint16)
                ids.append(doc)
                held.append(tokens)
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield close()
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None) -> TokenStore:
    """Encode every text, append ``end`` and write the data set. ``tokenizer``: a vocabulary file of word-level BPE."""
    spark = docs.sparkSession
    bound_batches(spark)
    if encoder(tokenizer).library.get_vocab_size() > 1 << 16 or end >= 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    path = path or shared_path(spark, "token-blocks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    raw_path = shared_path(spark, "raw-ids")
    raw = materialise(ordered.mapInArrow(_tokenised(tokenizer, end), _RAW_DDL), "", raw_path)
    counts = np.zeros(1 << 16, np.int64)
    for row in raw.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).collect():  # at most the vocabulary
        counts[row.token] = row.times
    freq = rans.quantise(counts)
    rows = raw.where("token is null").select("part", "doc_id", "first_token", "ids")
    rows.mapInArrow(_coded(freq), _BLOCKS_DDL).write.option("compression", "none").parquet(path)
    remove(spark, raw_path)
    return TokenStore(path, freq)


def _decoded(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(freq)
        for batch in batches:
            for part, first, raw in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("payload")):
                block = rans.Block(raw.as_py(), table)
                data = block.tokens().astype("<u4").tobytes()
                ends = np.cumsum(block.lengths.astype(np.int64))
                begins = ends - block.lengths
                crc = [zlib.crc32(memoryview(data)[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(block.ids, mask=block.absent), pa.array(first + begins), pa.array(block.lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "first_token", "n_tokens", "ids_crc32"])

    return run


def read_index(spark: SparkSession, store: TokenStore) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = store.blocks(spark)
    files = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file: the one window without a partition, over as many rows as there are files
    before = materialise(files.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")), "file-starts")
    docs = blocks.select("part", "first_token", "payload").mapInArrow(_decoded(store.freq), _DOCS_DDL)
    return docs.join(maybe_broadcast(before, before.count()), "part").select("doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")
