"""Exact dedup by content sort.

Spark samples splitters and range-partitions the rows by (the first characters of the normalised text, doc_id); its
external sort then orders each range by the whole normalised text and doc_id, which places equal texts next to each
other. Each task compares neighbouring normalised texts in full and marks runs. Texts whose first characters stand
at a border of a range may go on in the next one - that is how a text held by a third of all rows stays spread over
many tasks. The first row of such a run carries its text, and runs of equal texts, compared in full, are added up:
a handful a range, unless very many texts begin alike.

Defined cases: null text counts as empty; empty and blank texts are equal to each other; rows that repeat a
doc_id are separate members of the group; a null doc_id sorts after all others as the one to keep; an empty
table gives an empty result; other columns of the input are ignored here and kept by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, hand_back, materialise, maybe_broadcast, partitions

#: Characters of the normalised text in the splitters that Spark samples to the driver.
SPLITTER_CHARS = 64
#: Bytes of texts that a task holds back until it knows whether their first characters go on to its end.
HELD_BYTES = 4_000_000
_RUNS = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("run", pa.int64()), ("rows", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_nth", pa.int64()), ("text_sha256", pa.string()), ("edge_text", pa.string())])
_RUNS_DDL = "doc_id long, row_hash long, part int, nth long, run long, rows long, best_chars long, best_id long, best_nth long, text_sha256 string, edge_text string"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\u000b\f\r", "")


def _head(text):
    """The first SPLITTER_CHARS characters of the normalised text; as a rule the text's beginning is enough for them."""
    begin = normalised(F.left(text, F.lit(4 * SPLITTER_CHARS)))
    return F.left(F.when(F.length(begin) >= SPLITTER_CHARS, begin).otherwise(normalised(text)), F.lit(SPLITTER_CHARS))


class _Runs:
    """Runs of equal neighbours in one sorted partition; of the open run only ids, lengths and its text are held."""

    def __init__(self):
        self.part, self.run, self.seen = TaskContext.get().partitionId(), -1, 0
        self.held: list[tuple] = []  # of the open run: ids, whether they are null, lengths, hashes, positions
        self.text = self.head = None
        self.waiting: list[pa.RecordBatch] = []  # closed runs with the head of the last one, with their texts
        self.bytes = 0

    def close(self, edge: bool) -> pa.RecordBatch:
        ids, none, chars, hashes, nth = (np.concatenate([h[k] for h in self.held]) for k in range(5))
        longest = chars.max()
        best = np.lexsort((ids, none, -chars))[0]
        n, text = len(ids), self.text.as_py()
        self.bytes += len(text) + 120 * n
        sha = hashlib.sha256(text.encode()).hexdigest()
        columns = [
            pa.array(ids, mask=none), pa.array(hashes), pa.array(np.full(n, self.part, np.int32)), pa.array(nth), pa.array(np.full(n, self.run)), pa.array(np.full(n, n)), pa.array(np.full(n, longest)),
            pa.array(np.full(n, ids[best]), mask=np.full(n, none[best])), pa.array(np.full(n, nth[best])), pa.array([sha] * n, pa.string()), pa.array([text] + [None] * (n - 1) if edge else [None] * n, pa.string()),
        ]
        self.held = []
        return pa.RecordBatch.from_arrays(columns, schema=_RUNS)

    def settle(self, edge: bool) -> list[pa.RecordBatch]:
        """The waiting runs; those that cannot go on elsewhere don't need their texts any more."""
        out, self.waiting, self.bytes = self.waiting, [], 0
        return out if edge else [b.set_column(len(_RUNS) - 1, _RUNS[-1], pa.nulls(b.num_rows, pa.string())) for b in out]

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        norm, head = batch.column("norm"), batch.column("head")
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        rest = [batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("chars", "row_hash")] + [self.seen + np.arange(batch.num_rows)]
        self.seen += batch.num_rows
        same = np.zeros(batch.num_rows, bool)
        same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        same[0] = self.text is not None and norm[0].as_py() == self.text.as_py()
        cuts = np.flatnonzero(~same)
        if not len(cuts) or cuts[0] != 0:
            end = cuts[0] if len(cuts) else batch.num_rows
            self.held.append((ids[:end], *(x[:end] for x in rest)))
        for k, start in enumerate(cuts.tolist()):
            if self.held:
                self.waiting.append(self.close(True))
            if (new := head[start].as_py()) != self.head:
                yield from self.settle(self.first)
                self.first, self.head = self.head is None, new
            elif self.bytes > HELD_BYTES:
                yield from self.settle(True)
            self.run += 1
            end = cuts[k + 1] if k + 1 < len(cuts) else batch.num_rows
            self.held = [(ids[start:end], *(x[start:end] for x in rest))]
            self.text = pa.array([norm[start].as_py()], pa.string())[0]  # of its own, not a view of the batch

    first = True  # whether the open head is the partition's first


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for batch in batches:
        if batch.num_rows and (out := list(runs.add(batch))):
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        hand_back()
    if runs.held:
        runs.waiting.append(runs.close(True))
        yield pa.Table.from_batches(runs.settle(True)).combine_chunks().to_batches()[0]


def _found(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, row_hash, keep_id, group_size, text_sha256 and chosen (one row of each group)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # texts are normalised behind the exchange; sampling the splitters reads their beginnings alone
    dealt = rows.withColumn("head", _head(F.col("text"))).repartitionByRange(partitions(spark), "head", "doc_id")
    ordered = dealt.select("doc_id", "head", F.length("text").cast("long").alias("chars"), F.xxhash64("text").alias("row_hash"), normalised(F.col("text")).alias("norm")).sortWithinPartitions("norm", "doc_id")
    runs = materialise(ordered.mapInArrow(_mark_runs, _RUNS_DDL), "content-sort")
    best = F.min(F.struct((-F.col("best_chars")).alias("shorter"), F.col("best_id").isNull().alias("none"), "best_id", F.col("part").alias("best_part"), "best_nth"))
    edges = runs.where("edge_text is not null")
    equal = edges.groupBy("edge_text").agg(F.count("*").alias("parts"), F.sum("rows").alias("all_rows"), best.alias("best"), F.collect_list(F.struct("part", "run")).alias("runs")).where("parts > 1")
    # a text has one run a range
    spread = equal.select(F.explode("runs").alias("r"), "all_rows", "best").select("r.part", "r.run", "all_rows", F.col("best.best_id").alias("all_id"), F.col("best.best_part").alias("all_part"), F.col("best.best_nth").alias("all_nth"))
    spread = materialise(spread, "spread-runs")
    out = runs.drop("edge_text").join(maybe_broadcast(spread, spread.count(), 64), ["part", "run"], "left")
    joined = F.col("all_rows").isNotNull()
    chosen = F.when(joined, (F.col("part") == F.col("all_part")) & (F.col("nth") == F.col("all_nth"))).otherwise(F.col("nth") == F.col("best_nth"))
    return out.select("doc_id", "row_hash", F.when(joined, F.col("all_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("all_rows", "rows").alias("group_size"), "text_sha256", chosen.alias("chosen"))


def find_copies(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Rows that repeat the kept doc_id are kept."""
    return _found(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts with all its columns: of rows that repeat doc_id and text, one as well."""
    number, mark, times = (free_name(docs, n) for n in ("copy_id", "copy_hash", "copy_times"))
    # rows are known by doc_id and the hash of their text; ``times`` is null for rows that go
    groups = _found(docs).where("group_size > 1").groupBy("doc_id", "row_hash").agg(F.max("chosen").alias("stays"), F.count("*").alias("n"))
    groups = materialise(groups.where("not stays or n > 1"), "copy-rows").select(F.col("doc_id").alias(number), F.col("row_hash").alias(mark), F.when(F.col("stays"), F.col("n")).alias(times))
    total, repeated = groups.agg(F.count("*"), F.count(times)).first()
    keyed = docs.withColumns({number: F.col("doc_id").cast("long"), mark: F.xxhash64(F.coalesce("text", F.lit("")))})

    def on(other: DataFrame):
        return keyed[number].eqNullSafe(other[number]) & (keyed[mark] == other[mark])

    kept = keyed.join(maybe_broadcast(groups, total, 40), on(groups), "left_anti").drop(number, mark)
    if not repeated:
        return kept
    again = groups.where(F.col(times).isNotNull())
    again = keyed.join(maybe_broadcast(again, repeated, 40), on(again), "left_semi").groupBy(number, mark).agg(F.any_value(F.struct(*(keyed[f"`{c}`"] for c in docs.columns))).alias(times))
    return kept.unionByName(again.select(f"{times}.*"))
