"""Learner state over streams of answers and turns.

State is kept per key by Spark's state store; what goes out is the new state of the keys of each batch. Within a
batch rows are ordered by time, across batches by arrival; ``late_mastery_stream`` orders across batches too. The watermark variants are an extension: they finish
a window once no earlier events are expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.learner import DOWN, UP

EVENTS_DDL = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of all files under a path. A pattern (``events.parque[t]``) also fits a single file, a plain path only a folder."""
    reader = spark.readStream.schema(EVENTS_DDL)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which states of several variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def clamp_of(right: np.ndarray, up: float, down: float) -> tuple[float, float, float]:
    """A run of answers as m -> clamp(m + shift, low, high)."""
    shift, low, high = 0.0, 0.0, 1.0
    for r in right.tolist():
        step = up if r else down
        shift, low, high = shift + step, min(1.0, max(0.0, low + step)), min(1.0, max(0.0, high + step))
    return shift, low, high


#: An answer that waits: order of time, then number, and whether it is right.
_ANSWER = np.dtype([("ts", "<i8"), ("seq", "<i8"), ("right", "?")])
#: Waiting answers that a key keeps as one value; with more of them each slice of time has its own. And rows of a batch
#: that are taken at once.
FEW = 2_000
PIECE = 50_000


def _packed(rows: list[Row]) -> np.ndarray:
    last = 2**63 - 1  # rows without a time or a number come last
    return np.array([(last if r.us is None else r.us, last if r.seq is None else r.seq, bool(r.right)) for r in rows], _ANSWER)


class LateAnswers(StatefulProcessor):
    """Answers of a learner and concept in order of time, however they arrive.

    State: what is settled (mastery and counts of all slices of time that the watermark has passed) and the answers of
    later slices. A key's few waiting answers lie beside what is settled, so that a batch reads and writes one value;
    those of a key with many lie in their slices, each with the three numbers that they come to, and an arriving piece
    of a batch changes only the slices that it touches. A key has one timer, at the end of its first slice that waits:
    it settles all slices that the watermark has passed and forgets their answers.
    """

    def __init__(self, up: float, down: float, slice_ms: int, few: int = FEW):
        self.up, self.down, self.slice_ms, self.few = up, down, slice_ms, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "mastery double, attempts long, correct long, timer long, many boolean, waiting binary")
        self.slices = handle.getMapState("slices", "slice long", "shift double, low double, high double, attempts long, correct long")
        self.answers = handle.getMapState("answers", "slice long", "waiting binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        m, attempts, correct, timer, many, held = self.known.get() or (0.0, 0, 0, None, False, b"")
        few, first = np.frombuffer(held, _ANSWER), timer
        while piece := list(islice(rows, PIECE)):
            new = _packed(piece)
            end = self._end(int(new["ts"].min()))
            first = end if first is None else min(first, end)
            if many or len(few) + len(new) > self.few:
                self._add(np.concatenate([few, new]))
                few, many = few[:0], True
            else:
                few = np.concatenate([few, new])
                few = few[np.argsort(few, order=("ts", "seq"))]
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.known.update((m, attempts, correct, first, many, few.tobytes()))
        yield self._state(key, m, attempts, correct, few, self._waiting() if many else [])

    def _end(self, us: int) -> int:
        return (us // (self.slice_ms * 1000) + 1) * self.slice_ms

    def _add(self, new: np.ndarray) -> None:
        of = new["ts"] // (self.slice_ms * 1000)
        for s in np.unique(of).tolist():
            held = self.answers.getValue((s,)) if self.slices.containsKey((s,)) else (b"",)
            rows = np.concatenate([np.frombuffer(held[0], _ANSWER), new[of == s]])
            rows = rows[np.argsort(rows, order=("ts", "seq"))]
            self.answers.updateValue((s,), (rows.tobytes(),))
            self.slices.updateValue((s,), (*clamp_of(rows["right"], self.up, self.down), len(rows), int(rows["right"].sum())))

    def _waiting(self) -> list[tuple]:
        return sorted((k[0], *v) for k, v in self.slices.iterator())

    def _after(self, m: float, few: np.ndarray, slices: list[tuple]) -> float:
        for right in few["right"].tolist():
            m = min(1.0, max(0.0, m + (self.up if right else self.down)))
        for _, shift, low, high, _, _ in slices:
            m = max(low, min(high, m + shift))
        return m

    def _state(self, key, m: float, attempts: int, correct: int, few: np.ndarray, slices: list[tuple]) -> Row:
        waiting, right = len(few) + sum(x[4] for x in slices), int(few["right"].sum()) + sum(x[5] for x in slices)
        return Row(user_id=key[0], concept=key[1], mastery=self._after(m, few, slices), attempts=attempts + waiting, correct=correct + right, waiting=waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        m, attempts, correct, _, many, held = self.known.get()
        few, slices = np.frombuffer(held, _ANSWER), self._waiting() if many else []
        over = few["ts"] // (self.slice_ms * 1000) < passed // self.slice_ms
        done, few = few[over], few[~over]
        gone, slices = [x for x in slices if (x[0] + 1) * self.slice_ms <= passed], [x for x in slices if (x[0] + 1) * self.slice_ms > passed]
        for s, *_ in gone:
            self.slices.removeKey((s,))
            self.answers.removeKey((s,))
        m, attempts, correct = self._after(m, done, gone), attempts + len(done) + sum(x[4] for x in gone), correct + int(done["right"].sum()) + sum(x[5] for x in gone)
        timer = self._end(int(few["ts"][0])) if len(few) else (slices[0][0] + 1) * self.slice_ms if slices else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.known.update((m, attempts, correct, timer, bool(slices), few.tobytes()))
        yield self._state(key, m, attempts, correct, few, slices)

    def close(self) -> None:
        pass


class ArrivedAnswers(StatefulProcessor):
    """Answers of a learner and concept: those of a batch in order of time, after those of earlier batches."""

    def __init__(self, up: float, down: float):
        self.up, self.down = up, down

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "mastery double, attempts long, correct long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        m, attempts, correct = self.known.get() or (0.0, 0, 0)
        pieces = []
        while piece := list(islice(rows, PIECE)):
            pieces.append(_packed(piece))
        answers = np.concatenate(pieces)
        for right in answers["right"][np.argsort(answers, order=("ts", "seq"))].tolist():
            m = min(1.0, max(0.0, m + (self.up if right else self.down)))
        attempts, correct = attempts + len(answers), correct + int(answers["right"].sum())
        self.known.update((m, attempts, correct))
        yield Row(user_id=key[0], concept=key[1], mastery=m, attempts=attempts, correct=correct)

    def close(self) -> None:
        pass


def mastery_stream(answers: DataFrame, up: float = UP, down: float = DOWN) -> DataFrame:
    """user_id, concept, mastery, attempts, correct after each batch, from (user_id, concept, ts, seq, right).

    A key's answers of one batch are ordered in one task, 17 bytes each; ``files_per_trigger`` bounds a batch. The batch
    fold (:func:`..operators.learner.mastery`) has no such task. Run it within :func:`rocksdb`.
    """
    rows = answers.select("user_id", "concept", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "right")
    return rows.groupBy("user_id", "concept").transformWithState(ArrivedAnswers(up, down), "user_id long, concept string, mastery double, attempts long, correct long", "Update", "None")


def late_mastery_stream(answers: DataFrame, late: str = "2 days", slice_hours: int = 24, up: float = UP, down: float = DOWN, few: int = FEW) -> DataFrame:
    """user_id, concept, mastery, attempts, correct, waiting after each batch, from (user_id, concept, ts, seq, right).

    The state is that of all answers so far in order of time, also of those that arrive in a later batch than their
    successors, up to ``late`` behind the newest; older ones are left out. ``waiting`` counts the answers that may
    still get a predecessor. Rows without a time are left out. Run it within :func:`rocksdb`.
    """
    rows = answers.where("ts is not null").select("user_id", "concept", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "right").withWatermark("ts", late)
    return rows.groupBy("user_id", "concept").transformWithState(LateAnswers(up, down, slice_hours * 3_600_000, few), "user_id long, concept string, mastery double, attempts long, correct long, waiting long", "Update", "EventTime")


def explain_stream(turns: DataFrame) -> DataFrame:
    """session_id, turn, consecutive_explains of every turn, from (session_id, turn, action)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("turn")
        counts = []
        for action in rows["action"]:
            n = n + 1 if action == "explain" else 0
            counts.append(n)
        state.update((n,))
        yield pd.DataFrame({"session_id": key[0], "turn": rows["turn"].tolist(), "consecutive_explains": counts})

    return turns.groupBy("session_id").applyInPandasWithState(run, "session_id long, turn long, consecutive_explains long", "n long", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, mean_value) of tumbling windows; later events than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count("*").alias("events"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "events", "mean_value")


def study_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, events) of runs of a learner's events less than ``gap`` apart."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote under ``path``, batch by batch (column batch)."""
    spark = stream.sparkSession

    schema = stream.schema
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = query.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    query.awaitTermination()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{names}, batch int").option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
