"""Jobs over ranges of keys that resume: a ledger of states, and writes that can be repeated.

A job cuts its input into ranges of keys of about equal numbers of rows. Each range is one Spark job whose result
replaces the range's own folder, and only then does the ledger say that it is done. A job that died, was stopped or met
an error goes on with the ranges that aren't done; a range that was half written is written again as a whole. So every
input row is in the result once, however often the job was started. Batches of a stream are written the same way, each
into a folder of its own number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import staged

_ENTRY = "job string, piece int, low long, high long, state string, at timestamp, seq long, message string"
#: Parts into which the range of keys is counted, and from which ranges are put together.
CELLS = 4096


@dataclass(frozen=True)
class Ledger:
    """An append-only log of what became of each range of a job; ``path`` is a folder in a store that Spark reads."""

    spark: SparkSession
    path: str

    def note(self, rows: list[tuple]) -> None:
        """Append (job, piece, low, high, state, message) entries; one file each call."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        seq = int(now.timestamp() * 1e6)
        entries = [(job, piece, low, high, state, now, seq + k, message) for k, (job, piece, low, high, state, message) in enumerate(rows)]
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(self.path)

    def entries(self) -> DataFrame:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(_ENTRY).json(self.path) if there else self.spark.createDataFrame([], _ENTRY)

    def status(self, job: str | None = None) -> DataFrame:
        """(job, piece, low, high, state, attempts, message): each range's latest state and how often it was begun."""
        rows = self.entries() if job is None else self.entries().where(F.col("job") == job)
        latest = F.max_by(F.struct("low", "high", "state", "message"), F.struct("at", "seq"))
        return rows.groupBy("job", "piece").agg(latest.alias("l"), F.count_if(F.col("state") == "processing").alias("attempts")).select("job", "piece", "l.low", "l.high", "l.state", "attempts", "l.message")

    def jobs(self) -> DataFrame:
        """(job, status, done, pieces): error if a range is in error, done if all are, queued if none was begun, else processing."""
        s = self.status().groupBy("job").agg(F.count("*").alias("pieces"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "error").alias("bad"), F.count_if(F.col("state") == "queued").alias("waiting"))
        state = F.when(F.col("bad") > 0, "error").when(F.col("done") == F.col("pieces"), "done").when(F.col("waiting") == F.col("pieces"), "queued").otherwise("processing")
        return s.select("job", state.alias("status"), "done", "pieces")


def key_ranges(rows: DataFrame, key: str, pieces: int) -> list[tuple[int, int]]:
    """At most ``pieces`` ranges [low, high) that hold all whole-number keys, of about equal numbers of rows.

    Keys are counted in ``CELLS`` equal parts of their range, so what reaches the driver is bounded.
    """
    # rows may be costly to make, so they are made once, for their number by key
    keys = staged(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "keys")
    low, high = keys.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    step = max(1, -(-(high - low + 1) // CELLS))
    cell = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low)) / F.lit(step)).cast("int")
    counts = {r.c: r.n for r in keys.groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect()}
    total, seen, out, start = sum(counts.values()), 0, [], low
    for c in sorted(counts):
        seen += counts[c]
        if seen * pieces >= total * (len(out) + 1):
            end = min(low + (c + 1) * step, high + 1)
            out.append((start, end))
            start = end
    return out


def run(ledger: Ledger, job: str, rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], out: str, pieces: int = 16, stop_after: int | None = None) -> DataFrame:
    """Apply ``step`` to all ranges of ``rows`` that the ledger doesn't have as done, and return (status of) the job.

    The ranges are fixed when the job is first started: keys that come later belong to a new job. A range whose step
    fails is noted with its error and the next one begins. ``stop_after`` ends this call early, as a worker that is
    taken down would. Rows without key are no part of a range.
    """
    known = {r.piece: r for r in ledger.status(job).collect()}
    if not known:
        ranges = key_ranges(rows, key, pieces)
        ledger.note([(job, n, a, b, "queued", None) for n, (a, b) in enumerate(ranges)])
        known = {r.piece: r for r in ledger.status(job).collect()}
    begun = 0
    for piece in sorted(known):
        r = known[piece]
        if r.state == "done":
            continue
        if stop_after is not None and begun >= stop_after:
            break
        begun += 1
        ledger.note([(job, piece, r.low, r.high, "processing", None)])
        try:
            step(rows.where((F.col(key) >= r.low) & (F.col(key) < r.high))).write.mode("overwrite").parquet(f"{out}/piece={piece}")
        except Exception as failed:  # noqa: BLE001  the next range may be fine; the ledger keeps what happened
            ledger.note([(job, piece, r.low, r.high, "error", str(failed)[:500])])
        else:
            ledger.note([(job, piece, r.low, r.high, "done", None)])
    return ledger.status(job)


def results(ledger: Ledger, job: str, out: str) -> DataFrame:
    """What the finished ranges of a job wrote; folders of others, which may be half written, are left out."""
    done = sorted(r.piece for r in ledger.status(job).where("state = 'done'").collect())
    return ledger.spark.read.option("basePath", out).parquet(*(f"{out}/piece={p}" for p in done)).drop("piece")


def write_batches(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start a query that writes each batch of a stream into the folder of its number. A batch that is run again, after
    the query died between its write and its commit, replaces what it wrote. Ends when all there is has been read."""

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key; for sinks that get a key's new state with every batch."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
