"""A stored vector index: vectors kept by list as they came, and a search that reads the lists nearest to a query.

Lists are found by Lloyd steps over all vectors: tasks assign their vectors to the nearest of the centroids, which are
few, and add up sums per list, so that only partial sums are shuffled. Each list is a folder, so a search reads only the
folders that its queries probe. A list with many vectors is written by several tasks and read in several splits; a task
holds a batch of vectors, the queries that probe its list, and the best ``k`` of each.

``probes`` is how many lists a query reads; with all lists the search is exact. Vectors that are null, zero, of another
length than ``dim``, or hold null or non-finite components are not in the index and find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.staging import staged
from .retrieval import BLOCK_BYTES, _matrix

#: Rows of a list that one task writes, and the most lists that are fitted if none are asked for.
LIST_ROWS = 200_000
MOST_LISTS = 4096


def _units(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their unit vectors."""
    x = _matrix(batch.column("embedding"), dim)
    at = np.flatnonzero(np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0))
    return at, x[at]


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T).argmax(1)


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: its folder, its centroids (unit vectors) and the length of its vectors."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    kind: str  # type of the vectors

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @property
    def _ddl(self) -> str:
        return f"list int, chunk_id long, embedding {self.kind}"

    @staticmethod
    def _rows(chunks: DataFrame) -> DataFrame:
        return chunks.where("chunk_id is not null and embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")

    @classmethod
    def build(cls, spark: SparkSession, path: str, chunks: DataFrame, dim: int, lists: int | None = None, steps: int = 8) -> VectorIndex:
        """Fit ``lists`` lists (the square root of the number of vectors, if not given) and store all vectors."""
        rows = cls._rows(chunks).where(F.size("embedding") == dim)
        n = rows.count()
        lists = max(1, min(lists or min(MOST_LISTS, round(math.sqrt(n))), max(n, 1)))
        # the start: vectors of the smallest hashes of ids, different ones
        start = rows.groupBy("embedding").agg(F.min(F.xxhash64("chunk_id")).alias("h")).orderBy("h").limit(lists).select(F.lit(0).alias("chunk_id"), "embedding").toArrow().combine_chunks()
        centroids = _units(start.to_batches()[0], dim)[1] if start.num_rows else np.zeros((0, dim))
        if not len(centroids):
            centroids = np.eye(1, dim)
        for _ in range(steps):
            sums = rows.mapInArrow(_partial_sums(centroids), "list int, n long, total array<double>")
            totals = sums.select("list", "n", F.posexplode("total").alias("place", "v")).groupBy("list", "place").agg(F.sum("v").alias("v"))
            new = centroids.copy()
            got = totals.toArrow()  # lists x components
            if got.num_rows:
                new[got.column("list").to_numpy(), got.column("place").to_numpy()] = got.column("v").to_numpy()
            size = np.sqrt((new * new).sum(1))
            new = np.where(size[:, None] > 0, new / np.where(size > 0, size, 1)[:, None], centroids)
            done = np.abs(new - centroids).max() < 1e-6
            centroids = new
            if done:
                break
        index = cls(spark, path, centroids, rows.schema["embedding"].dataType.simpleString())
        index._write(rows, "overwrite")
        return index

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn("embedding", F.col("embedding").cast(self.kind))
        placed = staged(rows.mapInArrow(_assigned(self.centroids), self._ddl), "listed-vectors")
        tasks = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).alias("_tasks")))  # a row per list
        dealt = placed.join(tasks, "list").withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.col("_tasks")))
        dealt.repartition("list", "_salt").select("list", "chunk_id", "embedding").write.partitionBy("list").mode(mode).parquet(self.path)

    def extend(self, chunks: DataFrame) -> VectorIndex:
        """Add chunks with new ids to the lists that there are."""
        self._write(self._rows(chunks), "append")
        return self

    def probed(self, queries: DataFrame, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and unit vectors of a block of queries of checked size, and the lists that each of them reads."""
        asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        if (asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0) > BLOCK_BYTES:
            raise ValueError("ask fewer queries at once")
        ids, x = [np.zeros(0, np.int64)], [np.zeros((0, self.dim))]
        for b in asked.toArrow().to_batches():
            at, units = _units(b, self.dim)
            ids.append(b.column("chunk_id").to_numpy()[at])
            x.append(units)
        ids, x = np.concatenate(ids), np.concatenate(x)
        return ids, x, np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, : max(1, probes)]

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """query_id, chunk_id, sim, rank: the k most similar chunks of each query's lists, ties to the smaller id."""
        ids, x, lists = self.probed(queries, probes)
        if not len(ids):
            return self.spark.createDataFrame([], "query_id long, chunk_id long, sim double, rank int")
        rows = self.spark.read.schema(self._ddl).parquet(self.path).where(F.col("list").isin(np.unique(lists).tolist()))
        best = rows.select("list", "chunk_id", "embedding").mapInArrow(_best(ids, x, lists, k), "query_id long, chunk_id long, sim double")
        return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id"))).where(F.col("rank") <= k)


def _partial_sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            _, x = _units(batch, centroids.shape[1])
            near = _near(x, centroids)
            np.add.at(total, near, x)
            n += np.bincount(near, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["list", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch, centroids.shape[1])
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(_near(x, centroids).astype(np.int32)), kept.column("chunk_id"), kept.column("embedding")], ["list", "chunk_id", "embedding"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int):
    """The k best of each query among a task's vectors of the lists that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            unit = _matrix(batch.column("embedding"), x.shape[1])
            chunk, where = batch.column("chunk_id").to_numpy(), batch.column("list").to_numpy()
            for number in np.unique(where).tolist():
                rows, asks = np.flatnonzero(where == number), np.flatnonzero((lists == number).any(1))
                sims = np.round(x[asks] @ unit[rows].T, 6)
                for q, sim in zip(asks.tolist(), sims):
                    top = np.lexsort((chunk[rows], -sim))[:k]
                    s, c = sim[top], chunk[rows][top]
                    if q in held:
                        s, c = np.concatenate([held[q][0], s]), np.concatenate([held[q][1], c])
                        top = np.lexsort((c, -s))[:k]
                        s, c = s[top], c[top]
                    held[q] = s, c
        for q, (s, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[q])), pa.array(c), pa.array(s)], ["query_id", "chunk_id", "sim"])

    return run
