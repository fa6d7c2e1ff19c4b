"""What must not grow with the tables: calls of the state store, columns that travel, frames in Python."""

import datetime as dt
import random

import pytest

from studyweave.streaming import learners

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [0, 5, learners.FEW])
def test_one_timer_settles_all_slices_of_a_key(spark, tmp_path, few):
    """A key is told once a batch, however many of its slices the watermark passes; few or many waiting answers alike."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 12)), k, rng.random() < 0.6) for k in range(300)]
    rows.append((1, "a", rows[0][2], None, None))  # an answer without number or value is a wrong one, the last of its time
    ddl = "user_id long, concept string, ts timestamp, seq long, right boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    with learners.rocksdb(spark):
        out = learners.run_once(learners.late_mastery_stream(stream, "20 days", few=few), str(tmp_path / "late"), "update").collect()
        one = spark.readStream.schema(ddl).parquet(str(tmp_path / "in/*"))
        settled = learners.run_once(learners.late_mastery_stream(one, "1 hours", few=few), str(tmp_path / "settled"), "update").collect()
    want = {}
    for user, concept, _, _, right in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3])):
        m, n, c = want.get((user, concept), (0.0, 0, 0))
        want[user, concept] = (round(min(1.0, max(0.0, m + (0.1 if right else -0.05))), 9), n + 1, c + bool(right))
    for found in (out, settled):
        last = {(r.user_id, r.concept): (round(r.mastery, 9), r.attempts, r.correct) for r in sorted(found, key=lambda r: (r.attempts, r.batch))}
        assert {k: v[1:] for k, v in last.items()} == {k: v[1:] for k, v in want.items()}
        assert all(abs(last[k][0] - want[k][0]) < 1e-6 for k in want)
    assert len({(r.user_id, r.concept, r.batch) for r in settled}) == len(settled) == 2 * len(want)


def test_stream_takes_answers_without_time_or_value(spark, tmp_path):
    """An answer without a time is the last of its batch, one without a value is a wrong one."""
    ddl = "user_id long, concept string, ts timestamp, seq long, right boolean"
    rows = [(1, "a", None, 9, True), (1, "a", T0, 2, False), (1, "a", T0, 1, True), (1, "a", T0, 3, None), (None, None, T0, 4, True)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    with learners.rocksdb(spark):
        out = learners.run_once(learners.mastery_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), "update").collect()
    assert {(r.user_id, r.concept): (round(r.mastery, 9), r.attempts, r.correct) for r in out} == {(1, "a"): (0.1, 4, 2), (None, None): (0.1, 1, 1)}


def test_substring_pairs_never_become_rows(spark):
    """Of a word in every chunk only the first k chunks of a task leave it."""
    from pyspark.sql import functions as F

    from studyweave.operators import retrieval as R

    ids = [None, *range(200)]
    random.Random(1).shuffle(ids)
    chunks = spark.createDataFrame([(c, None if c == 3 else f"The WORD {c} " + "x" * 400) for c in ids], "chunk_id int, full_text string").repartition(3)
    asked = spark.createDataFrame([(1, "word"), (2, "19"), (3, ""), (4, None), (5, "no such"), (5, "word 7 ")], "query_id long, text string")
    hits = R.substring_search(asked, chunks, 4)
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
        assert len(r.snippet) == 300 and r.score == 1.0
    assert found == {1: [None, 0, 1, 2], 2: [19, 119, 190, 191], 5: [7]}
    assert dict(hits.dtypes)["chunk_id"] == "int"
    assert "NestedLoopJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert R.substring_search(asked.where(F.lit(False)), chunks, 4).count() == 0


def test_vectors_by_themselves_give_the_same_hits_without_a_sort_of_texts(spark):
    from pyspark.sql import functions as F

    from studyweave.operators import retrieval as R

    words = "heat flux entropy field wave".split()
    rng = random.Random(2)
    rows = [(c, "r", c % 4, " ".join(rng.choices(words, k=9)), [rng.random(), rng.random()] if c % 3 else None) for c in range(60)]
    whole = spark.createDataFrame(rows, "chunk_id long, resource_id string, page_number int, full_text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "heat wave", [1.0, 0.2]), (2, "flux", None)], "query_id long, text string, embedding array<double>")
    vectors = whole.select("chunk_id", "embedding").where("embedding is not null")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = R.hybrid_search(asked, whole.drop("embedding"), 7, vectors=vectors)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(hits.collect()) == sorted(R.hybrid_search(asked, whole, 7).collect())
        extra = whole.select("chunk_id", F.left("full_text", F.lit(5)).alias("snippet"))
        assert sorted(R.with_chunks(hits, extra).collect()) == sorted(hits.join(extra, "chunk_id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
