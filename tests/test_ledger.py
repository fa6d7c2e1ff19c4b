"""Jobs that are stopped, fail and resume; batches that are run again."""

import glob
import os
import random

from pyspark.sql import functions as F

from studyweave.sources import ledger


def test_key_ranges(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(10**6), 10**6) for _ in range(800)] + [7] * 400 + [10**9, None]
    rows = spark.createDataFrame([(k,) for k in keys], "id long")
    for pieces in (1, 4, 9):
        ranges = ledger.key_ranges(rows, "id", pieces)
        assert ranges[0][0] == min(k for k in keys if k is not None) and ranges[-1][1] == 10**9 + 1
        assert len(ranges) <= pieces and all(a < b for a, b in ranges) and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    even = ledger.key_ranges(spark.range(1000), "id", 4)
    assert [b - a for a, b in even] == [250] * 4
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,)], "id long")
    assert len(ledger.key_ranges(wide.where("id >= 0"), "id", 2)) == 2
    assert ledger.key_ranges(rows.limit(0), "id", 4) == []


def test_a_stopped_job_resumes(spark, tmp_path):
    log, out = ledger.Ledger(spark, str(tmp_path / "log")), str(tmp_path / "out")
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    calls = []

    def step(part):
        calls.append(1)
        return part.select("id", "v")

    assert log.jobs().count() == 0
    ledger.run(log, "double", rows, "id", step, out, pieces=5, stop_after=2)
    assert {r.piece: r.state for r in log.status("double").collect()} == {0: "done", 1: "done", 2: "queued", 3: "queued", 4: "queued"}
    assert log.jobs().first().status == "processing" and len(calls) == 2
    # a worker that died in the middle of the next range: it is noted as begun, and left a part of its rows
    log.note([("double", 2, 400, 600, "processing", None)])
    rows.where("id between 400 and 450").select("id", "v").write.parquet(f"{out}/piece=2")
    assert ledger.results(log, "double", out).count() == 400
    ledger.run(log, "double", rows, "id", step, out)
    assert len(calls) == 5
    found = [(r.id, r.v) for r in ledger.results(log, "double", out).collect()]
    assert sorted(found) == [(k, 2 * k) for k in range(1000)]
    assert {r.piece: r.attempts for r in log.status("double").collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    ledger.run(log, "double", rows, "id", step, out)
    assert len(calls) == 5 and log.jobs().first().status == "done"


def test_an_error_is_kept_and_the_rest_goes_on(spark, tmp_path):
    log, out = ledger.Ledger(spark, str(tmp_path / "log")), str(tmp_path / "out")
    rows = spark.range(90)
    bad = lambda part: part.select(F.when(F.col("id") == 40, F.raise_error(F.lit("page 40 is broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    ledger.run(log, "j", rows, "id", bad, out, pieces=3)
    got = {r.piece: (r.state, r.message) for r in log.status("j").collect()}
    assert [got[p][0] for p in range(3)] == ["done", "error", "done"] and "page 40 is broken" in got[1][1]
    assert log.jobs().first().status == "error" and ledger.results(log, "j", out).count() == 60
    ledger.run(log, "j", rows, "id", lambda part: part, out)
    assert sorted(r.id for r in ledger.results(log, "j", out).collect()) == list(range(90))
    ledger.run(log, "none", rows.limit(0), "id", bad, out)
    assert log.status("none").count() == 0


def test_batches_are_written_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(100).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    ledger.write_batches(stream, out, checkpoint).awaitTermination()
    read = lambda: sorted(r.id for r in spark.read.parquet(out).collect())
    assert read() == list(range(100)) and len(glob.glob(f"{out}/batch=*")) == 4
    # the last batch was written, but its commit was lost: it is run again after a restart
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    for crc in glob.glob(f"{checkpoint}/commits/.*.crc"):
        os.remove(crc)
    spark.range(100, 120).coalesce(1).write.mode("append").parquet(source)
    ledger.write_batches(stream, out, checkpoint).awaitTermination()
    assert read() == list(range(120))


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("b", 2, 7)], "k string, batch int, v int")
    assert sorted(map(tuple, ledger.latest(rows, ["k"], "batch").collect())) == [("a", 3, 6), ("b", 2, 7)]
