"""Byte-level BPE by overlapping chunks.

Texts are cut into chunks that overlap; tasks pre-tokenise the chunks independently and report the pre-token
boundaries in their overlaps. Neighbouring chunks are stitched at the first boundary on which both agree: the
pattern only looks ahead, so from a common boundary on both go on alike. That is a join of narrow rows. Then each
chunk's own piece, from seam to seam, is encoded where it lies, and a text's ids stream in order through one task
that makes the digests. Texts with a seam on which nothing agrees (one pre-token longer than the overlap, say) are
cut again into larger chunks with larger overlaps, at last into one. Every text goes this way, through the tables of
chunks, seams and pieces; one that fits into a chunk has no overlap, hence no seam, and its chunk is its only piece.

Decoding concatenates the bytes of the ids.

Defined cases: null text is empty (no ids); rows that repeat a doc_id or have none stay separate; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hand_back, materialise, maybe_broadcast, remove, table_path

#: Characters of a chunk and of its overlap with the next one, and how much larger they are in a further round.
CHUNK = 1 << 15
OVERLAP = 1 << 10
GROWTH = 8
#: The pattern decides on a boundary by the three characters after it at most.
LOOK = 3

_codecs: dict[tuple[str, str], "Codec"] = {}
_CHUNK = ["row", "doc_id", "k", "of", "chunk"]
_RESULT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
_RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def codec(ranks: str, pattern: str) -> "Codec":
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = Codec(ranks, pattern)
    return _codecs[ranks, pattern]


class Codec:
    """A rank file and its pattern."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token
        self.digits = [b"%d" % k for k in range(len(self.bytes_of))]

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece between two boundaries."""
        return self.library.encode_ordinary(piece)

    def boundaries(self, chunk: str, closing: bool) -> Iterator[int]:
        """Ends of the pre-tokens of a chunk. Those at its end may go on beyond it or, being an apostrophe, start a
        contraction there; unless the text ends with it, what ends within LOOK characters of its end is left out."""
        for m in self.pattern.finditer(chunk):
            if m.end() > len(chunk) - LOOK and not closing:
                break
            yield m.end()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Digest:
    """Number of ids, and digests of their decimals and of the bytes they decode to, of pieces in order."""

    def __init__(self, c: Codec):
        self.codec, self.n, self.ids, self.decoded = c, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> "Digest":
        if ids:
            self.ids.update(b" " * (self.n > 0) + b" ".join(map(self.codec.digits.__getitem__, ids)))
            self.decoded.update(self.codec.decode(ids))
            self.n += len(ids)
        return self

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def _digested(doc_ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, decoded = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], _RESULT)


def _alone(ranks: str, pattern: str):
    """Digests of texts whose only piece this is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            yield _digested(batch.column("doc_id"), [Digest(c).add(c.encode(p.as_py())).row() for p in batch.column("piece")])
            hand_back()

    return run


def _scanned(ranks: str, pattern: str, size: int, overlap: int):
    """Each chunk with its boundaries in the overlap with the chunk before (from 0 on) and the one after it, both
    counted from the beginning of the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            heads, tails = [], []
            for of, chunk, closing in zip(batch.column("of").to_pylist(), batch.column("chunk"), batch.column("closing")):
                ends = list(c.boundaries(chunk.as_py(), closing.as_py())) if of > 1 else []  # an only chunk overlaps with none
                heads.append([0, *(e for e in ends if e <= overlap)])
                tails.append([e - size for e in ends if e >= size])
            both = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _CHUNK), *both], [*_CHUNK, "head", "tail"])
            hand_back()

    return run


def _encoded(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            ids = [np.array(c.encode(p.as_py()), "<u4").tobytes() for p in batch.column("piece")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "k")), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "ids"])
            hand_back()

    return run


def _joined(ranks: str, pattern: str):
    """Digests of texts whose pieces come one after the other; one piece is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row, doc, digest = codec(ranks, pattern), None, None, None
        for batch in batches:
            for r, d, ids in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if r != row:
                    if digest:
                        yield _digested(pa.array([doc], pa.int64()), [digest.row()])
                    row, doc, digest = r, d, Digest(c)
                digest.add(np.frombuffer(ids.as_buffer(), "<u4").tolist())
        if digest:
            yield _digested(pa.array([doc], pa.int64()), [digest.row()])

    return run


def _chunked(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(row, doc_id, k, of, chunk, closing) of texts (row, doc_id, text): the k-th of so many chunks."""
    n = F.length("text")
    cut = texts.select("row", "doc_id", "text", n.alias("n"), F.greatest(F.lit(1), F.ceil(n / size)).cast("int").alias("of"))
    cut = cut.select("row", "doc_id", "text", "n", "of", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("k"))
    return cut.select("row", "doc_id", "k", "of", F.substring("text", F.col("k") * size + 1, F.lit(size + overlap)).alias("chunk"), (F.col("k") * size + size + overlap >= F.col("n")).alias("closing"))


def _stitched(cut: DataFrame, ranks: str, pattern: str, size: int, overlap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, pieces of the texts whose chunks all meet, rows of the others)."""
    chunks = cut.mapInArrow(_scanned(ranks, pattern, size, overlap), "row long, doc_id long, k int, of int, chunk string, head array<int>, tail array<int>")
    chunks = materialise(chunks, "chunks")
    many, only = chunks.where("of > 1"), chunks.where("of = 1")
    after = many.select("row", (F.col("k") - 1).alias("k"), "head")
    seams = materialise(many.select("row", "k", "tail").join(after, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("tail", "head")).alias("seam")), "seams")
    apart = seams.where("seam is null").select("row").distinct()
    bounds = seams.select("row", "k", (F.col("seam") + size).alias("stop")).join(seams.select("row", (F.col("k") + 1).alias("k"), F.col("seam").alias("start")), ["row", "k"], "full")
    bounds = bounds.join(apart, "row", "left_anti")
    pieces = many.join(apart, "row", "left_anti").join(bounds, ["row", "k"], "left")
    start = F.coalesce("start", F.lit(0))
    pieces = pieces.select("row", "doc_id", "k", "of", F.substring("chunk", start + 1, F.coalesce("stop", F.length("chunk")) - start).alias("piece"))
    return chunks, only.select("row", "doc_id", "k", "of", F.col("chunk").alias("piece")).union(pieces), apart


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # chunks of longer texts are dealt over tasks; an only chunk stays where its text is
    short, long = (_chunked(texts.where(test), chunk, overlap) for test in (F.length("text") <= chunk, F.length("text") > chunk))
    cut, used, encoded, out = short.union(long.repartition("row", "k")), [], [], None
    while True:
        chunks, pieces, apart = _stitched(cut, ranks, pattern, chunk, overlap)
        done = pieces.where("of = 1").mapInArrow(_alone(ranks, pattern), _RESULT_DDL)
        out = done if out is None else out.union(done)
        encoded.append(materialise(pieces.where("of > 1").mapInArrow(_encoded(ranks, pattern), "row long, doc_id long, k int, ids binary"), "pieces"))
        apart = materialise(apart, "apart")
        used.append(apart)
        again = apart.count()
        if not again:
            break
        # texts to cut again are put together from the chunks that each begins with
        left = chunks.join(maybe_broadcast(apart, again), "row", "left_semi").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", F.left("chunk", F.lit(chunk)).alias("part")))).alias("parts"))
        chunk, overlap = chunk * GROWTH, overlap * GROWTH
        cut = _chunked(left.select("row", "doc_id", F.array_join("parts.part", "").alias("text")), chunk, overlap).repartition("row", "k")
    remove(spark, *(table_path(t) for t in used))
    for pieces in encoded:
        ordered = pieces.repartition("row").sortWithinPartitions("row", "k")
        out = out.union(ordered.mapInArrow(_joined(ranks, pattern), _RESULT_DDL))
    return out
