"""Exact nearest neighbours of a query set by a block matrix join with int8 tiles.

Vectors are scaled to length one and quantised to int8 with their own scale; the length of what quantisation
drops is kept, which bounds the error of every product: |x.y - s_x s_y (q_x.q_y)| <= e_x + e_y + e_x e_y, e being
those lengths. Candidates and queries are cut into tiles; each pair of tiles is one integer matrix product. In a
tile pair a candidate survives for a query if its upper bound reaches the k-th largest lower bound there; the
lower bounds of all tiles then give each query one threshold. Survivors are recomputed in double precision on
the original vectors and merged by bounded heaps. Equal vectors are one class in all that: only the k + 1 smallest
ids of a class can be among anyone's k nearest.

Defined cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do
null vec_ids; ties go to the smaller vec_id; a query with fewer than k candidates gets them all; rows that
repeat a vec_id are separate candidates, but never neighbours of the query with that id (a query is asked once per
id and vector); vectors whose length
differs from the query's are no candidates; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, remove, table_path

#: Rows of a tile.
TILE = 4096
#: Bytes of query tiles that one broadcast holds.
BLOCK_BYTES = 16_000_000
#: Room for rounding in the bounds; the products themselves are exact integers.
SLACK = 1e-9
_TILE_DDL = "tile long, dim int, ids binary, codes binary, scale binary, drop binary"
_BOUND_DDL = "query_id long, vec_id long, low double, high double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantised tiles of up to TILE rows of one dimension."""
    held: dict[int, list] = {}

    def close(dim: int):
        ids = np.concatenate([h[0] for h in held[dim]])
        x = np.concatenate([h[1] for h in held[dim]])
        del held[dim]
        x = x / np.abs(x).max(1)[:, None]  # keeps squares of tiny and huge components in range
        x /= np.sqrt((x * x).sum(1))[:, None]
        scale = np.abs(x).max(1) / 127
        codes = np.rint(x / scale[:, None])
        drop = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
        row = [[int(ids[0]) * 31 + len(ids)], [dim], [ids.astype("<i8").tobytes()], [codes.astype(np.int8).tobytes()], [scale.tobytes()], [drop.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 4))], ["tile", "dim", "ids", "codes", "scale", "drop"])

    for batch in batches:
        ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
        sizes = lists.value_lengths().to_numpy()
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            x = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
            for low in range(0, len(rows), TILE):
                held.setdefault(int(dim), []).append((ids[rows[low : low + TILE]], x[low : low + TILE]))
                if sum(len(h[0]) for h in held[int(dim)]) >= TILE:
                    yield close(int(dim))
    for dim in list(held):
        yield close(dim)


def _products(k: int):
    """Survivors among a task's tiles for the queries of a block, with the bounds of their products.

    Per query the k largest lower bounds met so far are kept; what cannot reach the least of them is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        held: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)
                dim, tile = batch.column("dim")[r].as_py(), batch.column("q_tile")[r].as_py()
                qi, ci = get("q_ids", "<i8"), get("ids", "<i8")
                # sums of at most 2^16 products of int8 stay exact in double precision
                codes = get("codes", np.int8).reshape(-1, dim).astype(np.float64)
                qs, cs, qd, cd = (get(c, np.float64) for c in ("q_scale", "scale", "q_drop", "drop"))
                lows = best.setdefault(tile, np.full((len(qi), k), -np.inf))
                for at in range(0, len(qi), 256):
                    part = slice(at, at + 256)
                    near = (get("q_codes", np.int8).reshape(-1, dim)[part].astype(np.float64) @ codes.T) * qs[part, None] * cs[None]
                    error = qd[part, None] + cd[None] + qd[part, None] * cd[None] + SLACK
                    low = near - error
                    lows[part] = np.partition(np.concatenate([lows[part], low], axis=1), -k, axis=1)[:, -k:]
                    q, c = np.nonzero(near + error >= lows[part].min(1)[:, None])
                    held.setdefault(tile, []).append((q + at, ci[c], low[q, c], (near + error)[q, c], qi))
                if sum(len(h[0]) for h in held[tile]) > 4 * k * len(qi) + 100_000:
                    held[tile] = [_reaching(held[tile], lows)]
        for tile, parts in held.items():
            q, c, low, high, qi = _reaching(parts, best[tile])
            yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(c), pa.array(low), pa.array(high)], ["query_id", "vec_id", "low", "high"])

    return run


def _reaching(parts: list, lows: np.ndarray) -> tuple:
    """Survivors whose upper bound reaches the k-th largest lower bound of their query."""
    q, c, low, high = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keep = high >= lows.min(1)[q]
    return q[keep], c[keep], low[keep], high[keep], parts[0][4]


def _in_order(x: np.ndarray) -> np.ndarray:
    """Row sums in double precision, component after component."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total = total + x[:, d]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a / np.abs(a).max(1)[:, None], b / np.abs(b).max(1)[:, None]
    return _in_order(a * b) / (np.sqrt(_in_order(a * a)) * np.sqrt(_in_order(b * b)))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("qv"), batch.column("cv")
        out, dims = np.empty(batch.num_rows), left.value_lengths().to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            a, b = (x.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim) for x in (left, right))
            plain = (_in_order(a * b), _in_order(a * a), _in_order(b * b))
            with np.errstate(all="ignore"):
                score = plain[0] / (np.sqrt(plain[1]) * np.sqrt(plain[2]))
            odd = ~np.isfinite(score) | ~np.isfinite(plain[1] * plain[2]) | (plain[1] < 1e-280) | (plain[2] < 1e-280)
            if odd.any():
                score[odd] = cosine(a[odd], b[odd])
            out[rows] = score
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(out)], ["query_id", "vec_id", "score"])


def _merge(k: int):
    """The k best of a query, itself left out, by a heap of k entries."""

    def run(key, batches):
        heap: list[tuple[float, int]] = []
        for score, vec in zip(batches.column("score").to_pylist(), batches.column("vec_id").to_pylist()):
            item = (score, -vec)
            if vec == key[1].as_py():
                continue
            if len(heap) < k:
                heapq.heappush(heap, item)
            else:
                heapq.heappushpop(heap, item)
        best = sorted(heap, reverse=True)
        n = len(best)
        return pa.table({"query_id": pa.array([key[1].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array([-v for _, v in best], pa.int64()), "score": pa.array([s for s, _ in best], pa.float64())})

    return run


def _members(rows: DataFrame, k: int) -> DataFrame:
    """(v, vec_id): per class of equal vectors its k + 1 smallest ids, each up to k times if it repeats.

    No further member can be among the k nearest of any query: as many equal ones with smaller ids come first.
    Spark limits ranked windows before the shuffle, so a large class does not meet in one task.
    """
    each = rows.withColumn("nth", F.row_number().over(W.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("nth") <= k)
    first = each.withColumn("place", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return first.select("v", "vec_id")


def _classes(rows: DataFrame) -> DataFrame:
    """(vec_id, v): each distinct vector once, with a number of its own as vec_id."""
    return rows.select("v").distinct().withColumn("vec_id", F.monotonically_increasing_id())


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors by cosine, itself left out."""
    spark = vectors.sparkSession
    members = materialise(_members(usable(vectors), k), "members")
    # classes of equal vectors are numbered; in what follows vec_id and query_id are those numbers until the last step
    classes = materialise(_classes(members), "classes")
    ids = materialise(members.join(classes.withColumnRenamed("vec_id", "class"), "v").select("class", "vec_id"), "class-ids")
    asked = usable(queries)
    asks = materialise(_classes(asked), "asked")
    tiles = materialise(classes.mapInArrow(_tiles, _TILE_DDL), "tiles")
    full = asks.repartition(max(1, -(-asks.count() // TILE)), "vec_id").mapInArrow(_tiles, _TILE_DDL)
    columns = [F.monotonically_increasing_id().alias("q_tile"), F.col("dim").alias("q_dim"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "scale", "drop"))]
    query_tiles = materialise(full.select(*columns), "query-tiles")
    # blocks of queries are broadcast, each of a size that was summed first; every block meets all tiles where they lie
    size = query_tiles.agg(F.sum(F.length("q_ids") + F.length("q_codes") + F.length("q_scale") + F.length("q_drop"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = []
    for n in range(blocks):
        block = query_tiles.where(F.pmod(F.xxhash64("q_tile"), F.lit(blocks)) == n)
        pairs = tiles.join(F.broadcast(block), F.col("dim") == F.col("q_dim"))
        found.append(materialise(pairs.mapInArrow(_products(k + 1), _BOUND_DDL), "bounds"))
    bounds = reduce(DataFrame.union, found)
    # a query's own class may be one of them, so k + 1 classes hold its k nearest
    least = bounds.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("nth") == k + 1).select("query_id", F.col("low").alias("threshold"))
    left = bounds.join(least, "query_id", "left").where(F.col("threshold").isNull() | (F.col("high") >= F.col("threshold"))).select("query_id", "vec_id").distinct()
    scored = left.join(asks.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(classes.select("vec_id", F.col("v").alias("cv")), "vec_id")
    scores = materialise(scored.select("query_id", "vec_id", "qv", "cv").mapInArrow(_scores, "query_id long, vec_id long, score double"), "scores")
    best = scores.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    least = best.where(F.col("nth") == k + 1).select("query_id", F.col("score").alias("least"))
    best = best.drop("nth").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
    # from classes back to rows: those of the best classes, in order of score and id, as far as any member of the query's class needs
    rows = best.withColumnRenamed("vec_id", "class").join(ids, "class").select(F.col("query_id").alias("ask"), "vec_id", "score")
    place = F.dense_rank().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    rows = materialise(rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "found")
    members_asked = asked.join(asks.select(F.col("vec_id").alias("ask"), "v"), "v").select("ask", F.col("vec_id").alias("query_id")).distinct()
    result = materialise(members_asked.join(rows, "ask").groupBy("ask", "query_id").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double"), "nearest")
    remove(spark, *(table_path(t) for t in (members, classes, ids, asks, tiles, query_tiles, scores, rows, *found)))
    return result
