"""Centroid clustering by Yinyang grouping, exact in integers.

Vectors become integers. The centroids are cut into groups once; each vector keeps an upper bound of the distance to
its own centroid and one lower bound per group for all others of that group. After a round the bounds move by the
drifts of the centroids. A vector whose upper bound lies below all its lower bounds stays where it is (global filter);
else its own distance is measured and only groups whose lower bound it reaches are scanned (group filter). Bounds have
room for rounding and a tie never passes a filter, so the result is that of a full scan. Each round writes the state of
all vectors as a table; sums per centroid are added up in tasks before they are shuffled, so a centroid with most of
the vectors is no bottleneck. Only centroids reach the driver: their number is a parameter.

Defined cases: vectors that are null, of another length or that hold null or non-finite components take no part; with
fewer vectors than centroids each vector starts one; rows without vec_id are assigned but start no centroid; rows that
repeat a vec_id count each; equal vectors may start several centroids, of which the larger numbers stay empty and
where they are; without any vector with an id the result is empty, as is that of an empty table. Components whose
integers pass 2^21 are measured in Python's integers; distances and sums beyond a long are null. Vectors with a
component beyond 1e33 take no part, as non-finite ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hand_back, materialise, remove, table_path

#: Centroids of a group, on average.
PER_GROUP = 10
#: Integers of up to this size have exact squared distances in double precision (64 components and more).
EXACT = 1 << 21
#: Components beyond this have integers of more than 38 digits, which Spark's decimals don't hold.
LARGEST = 1e33
#: Room for rounding in bounds, as a share.
SLACK = 1e-12
_STATE = "vec_id long, q binary, wide array<decimal(38,0)>, own int, upper double, lower array<double>"
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _floors(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, and rows whose integers are too large for exact doubles."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    return q, ~(np.abs(q) <= EXACT).all(1)


def _whole(x: np.ndarray, scale: float) -> list[int]:
    """The integers of one vector, whatever their size."""
    return [math.floor(scale * v) for v in x.tolist()]


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids; exact, for all integers are at most EXACT."""
    return (q * q).sum(1)[:, None] - 2 * (q @ centroids.T) + (centroids * centroids).sum(1)[None]


def group_centroids(centroids: list[list[int]], rounds: int = 5) -> list[list[int]]:
    """Numbers of the centroids in each group: a few rounds of clustering over the centroids themselves."""
    k = len(centroids)
    c = np.array(centroids, float)
    t = max(1, k // PER_GROUP)
    mid = c[:: max(1, k // t)][:t].copy()
    for _ in range(rounds):
        near = ((c[:, None] - mid[None]) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (near == g).any():
                mid[g] = c[near == g].mean(0)
    return [np.flatnonzero(near == g).tolist() for g in range(t) if (near == g).any()]


class Assigner:
    """One round's assignment of batches of vectors; ``scanned`` counts the distances that filters left to measure."""

    def __init__(self, centroids: list[list[int]], groups: list[list[int]], drifts: list[float] | None):
        self.whole, self.groups = centroids, groups
        self.fits = max((abs(v) for c in centroids for v in c), default=0) <= EXACT
        self.c = np.array(centroids, float)
        self.group_of = np.zeros(len(centroids), int)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        self.drifts = None if drifts is None else np.array(drifts)
        self.scanned = 0

    def exact_row(self, q: list[int]) -> tuple[int, int]:
        """Nearest centroid and distance in Python's integers."""
        d, n = min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(self.whole))
        return n, d

    def assign(self, q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (own, upper, lower) of a batch of vectors with exact doubles."""
        n = len(q)
        if self.drifts is None:  # first round
            return self._scan(q, np.full(n, -1), np.full(n, np.inf), np.zeros((n, len(self.groups))))
        upper = (upper + self.drifts[own]) * (1 + SLACK)
        lower = np.maximum(0, lower - np.array([self.drifts[g].max() for g in self.groups])[None]) * (1 - SLACK)
        todo = np.flatnonzero(upper >= lower.min(1))  # global filter
        if len(todo):
            d = ((q[todo] - self.c[own[todo]]) ** 2).sum(1)
            self.scanned += len(todo)
            upper[todo] = np.sqrt(d) * (1 + SLACK)
            todo = todo[upper[todo] >= lower[todo].min(1)]
        if len(todo):
            own[todo], upper[todo], lower[todo] = self._scan(q[todo], own[todo], upper[todo], lower[todo])
        return own, upper, lower

    def _scan(self, q, own, upper, lower):
        """Group filter and exact scan of the groups that are left."""
        n, first = len(q), own.copy()
        best = np.where(first >= 0, ((q - self.c[first]) ** 2).sum(1), np.inf)
        own = first.copy()
        seen = np.zeros((n, len(self.groups)), bool)
        least = np.full((n, len(self.groups), 2), np.inf)  # the two smallest distances in each scanned group
        for g, members in enumerate(self.groups):
            at = np.flatnonzero((upper >= lower[:, g]) | (first < 0))
            if not len(at):
                continue
            d = squared(q[at], self.c[members])
            self.scanned += d.size
            seen[at, g] = True
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            least[at, g, : order.shape[1]] = np.take_along_axis(d, order, 1)
            near, dist = np.array(members)[order[:, 0]], least[at, g, 0]
            better = (dist < best[at]) | ((dist == best[at]) & ((near < own[at]) | (own[at] < 0)))
            own[at[better]], best[at[better]] = near[better], dist[better]
        mine = self.group_of[own]
        for g in range(len(self.groups)):
            # the bound holds for all of the group's centroids but the vector's own one
            new = np.where(mine == g, least[:, g, 1], least[:, g, 0])
            lower[:, g] = np.where(seen[:, g], np.sqrt(new) * (1 - SLACK), lower[:, g])
            # a centroid given up in a group that was not scanned again can't occur: its distance is its upper bound
            left = (first >= 0) & (first != own) & (self.group_of[first] == g) & ~seen[:, g]
            lower[left, g] = np.minimum(lower[left, g], upper[left] * (1 - 3 * SLACK))
        return own, np.sqrt(best) * (1 + SLACK), lower


def _decimals(rows) -> pa.Array:
    return pa.array(rows, pa.list_(pa.decimal128(38, 0)))


def _start(dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            q, large = _floors(x, scale)
            small = np.where(large[:, None], 0, q).astype("<i4")
            n, wide = batch.num_rows, {k: [Decimal(v) for v in _whole(x[k], scale)] for k in np.flatnonzero(large).tolist()}
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in small], pa.binary()), _decimals([wide.get(k) for k in range(n)]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64()))], ["vec_id", "q", "wide", "own", "upper", "lower"])

    return run


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, list[int]]]:
    q = np.frombuffer(b"".join(batch.column("q").to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(float) if batch.num_rows else np.zeros((0, 1))
    wide = batch.column("wide")
    return q, {k: [int(v) for v in wide[k].as_py()] for k in np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False)).tolist()}


def _assign_all(centroids, groups, drifts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Assigner(centroids, groups, drifts)
        for batch in batches:
            q, wide = _read(batch)
            n = batch.num_rows
            own, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, len(groups)))
            plain = np.array([k for k in range(n) if k not in wide] if work.fits else [], np.int64)
            if len(plain):
                if drifts is not None:
                    own[plain] = batch.column("own").to_numpy()[plain]
                    upper[plain] = batch.column("upper").to_numpy()[plain]
                    lower[plain] = batch.column("lower").flatten().to_numpy().reshape(n, -1)[plain]
                own[plain], upper[plain], lower[plain] = work.assign(q[plain], own[plain], upper[plain], lower[plain])
            for k in range(n) if not work.fits else wide:
                # bounds that pass no filter: this row is scanned whole in every round
                own[k], upper[k] = work.exact_row(wide.get(k) or [int(v) for v in q[k]])[0], np.inf
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), batch.column("wide"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(list(lower), pa.list_(pa.float64()))], ["vec_id", "q", "wide", "own", "upper", "lower"])
            hand_back()

    return run


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of each centroid's vectors in a task."""
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        q, wide = _read(batch)
        own = batch.column("own").to_numpy()
        for c in np.unique(own).tolist():
            at = np.flatnonzero(own == c)
            part = [int(v) for v in q[at].sum(0)]
            for k in at.tolist() if wide else []:
                part = [a + b for a, b in zip(part, wide.get(k, [0] * len(part)))]
            sums[c] = [a + b for a, b in zip(sums.get(c, [0] * len(part)), part)]
            counts[c] = counts.get(c, 0) + len(at)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([counts[c] for c in sums], pa.int64()), _decimals([[Decimal(v) for v in s] for s in sums.values()])], ["own", "n", "sums"])


def _new_centroids(state: DataFrame, old: list[list[int]]) -> list[list[int]]:
    parts = state.mapInArrow(_partial_sums, "own int, n long, sums array<decimal(38,0)>")
    totals = parts.select("own", "n", F.posexplode("sums").alias("place", "part")).groupBy("own", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    new = [list(c) for c in old]
    for r in totals.collect():  # centroids x components
        new[r.own][r.place] = int(r.total) // r.n
    return new


def _measured(centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, float)
        fits = max((abs(v) for x in centroids for v in x), default=0) <= EXACT
        for batch in batches:
            q, wide = _read(batch)
            own = batch.column("own").to_numpy()
            if fits:
                d = ((q - c[own]) ** 2).sum(1).astype(np.int64).tolist()
            else:
                d = [0] * batch.num_rows
            for k in range(batch.num_rows) if not fits else wide:
                d[k] = sum((a - b) ** 2 for a, b in zip(wide.get(k) or [int(v) for v in q[k]], centroids[own[k]]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("own"), pa.array([Decimal(v) if v < 10**38 else None for v in d], pa.decimal128(38, 0))], ["vec_id", "cluster", "d"])

    return run


def _distance(a: list[int], b: list[int]) -> float:
    return float(sum((x - y) ** 2 for x, y in zip(a, b))) ** 0.5 * (1 + SLACK)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    state = materialise(usable(vectors, dim).mapInArrow(_start(dim, scale), _STATE), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # components grow with their integers, so ties of ids are in the order of the integers
    first = usable(vectors, dim).where("vec_id is not null").select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = [_whole(np.array(r.x), scale) for r in first]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], result)
    groups, drifts = group_centroids(centroids), None
    for n in range(rounds + 1):
        after = materialise(state.mapInArrow(_assign_all(centroids, groups, drifts), _STATE), "assigned")
        remove(spark, table_path(state))
        state = after
        if n < rounds:
            new = _new_centroids(state, centroids)
            drifts = [_distance(a, b) for a, b in zip(centroids, new)]
            centroids = new
    found = materialise(state.mapInArrow(_measured(centroids), "vec_id long, cluster int, d decimal(38,0)"), "measured")
    remove(spark, table_path(state))
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("d").alias("total")).collect()}
    fit = lambda v: int(v) if v is not None and v <= _LONG else None
    whole = fit(sum(sums.values())) if sums and None not in sums.values() else None
    about = [(c, fit(t), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sums.items()]
    about = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # at most k rows
    return found.join(about, "cluster").select("vec_id", "cluster", F.when(F.col("d") <= _LONG, F.col("d").cast("long")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
