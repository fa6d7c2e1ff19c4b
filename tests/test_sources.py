"""Sinks and small sources on literal rows."""

import json

from pyspark.sql import functions as F

from studyweave.sources import io


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    io.write_records(df, str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [1, 2]
    io.write_csv(df, str(tmp_path / "c"))
    text = "\n".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert "id,name" in text and "1,a" in text


def test_by_ids(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string")
    ids = spark.createDataFrame([(4,), (1,), (99,), (1,)], "id long")
    assert sorted(r.id for r in io.by_ids(df, ids).collect()) == [1, 4]


def test_job_status(spark):
    log = spark.createDataFrame([("a", "queued", 1, 0), ("a", "done", 3, 2), ("a", "processing", 3, 1), ("b", "error", 2, 0)], "job_id string, status string, at int, seq int")
    assert {r.job_id: (r.status, r.at) for r in io.job_status(log).collect()} == {"a": ("done", 3), "b": ("error", 2)}


def test_report_markdown(spark):
    row = spark.createDataFrame([(3, "A+")], "total int, grade string")
    assert io.report_markdown(row, "Quality") == "# Quality\n\n- total: 3\n- grade: A+\n"
    assert io.report_markdown(row.limit(0), "Quality") == "# Quality\n\n\n"


def test_broken_json(spark):
    texts = ["{'a': 1}", "{\"a\": {\"b\": [1, 2,]}} tail }", "``` {\"x\": 1} ```", "", None, "[1, 2]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(io.extracted_json(F.col("text"))).collect()]
    assert len(got) == 6 and json.loads(got[2]) == {"x": 1}


def test_objects_in_answers(spark):
    cases = {
        'a {"x": {"y": "}"}} b {"z": 1,} {"cut": {"in": 1}': ['{"x": {"y": "}"}}', '{"z": 1}'],
        'say "hi {"a": "q\\" { ,}", "b": [1, 2, ], }': ['{"a": "q\\" { ,}", "b": [1, 2 ] }'],
        "```json\n{\"a\": 1}\n```": ['{"a": 1}'],
        'x {} BEGIN_STRICT_JSON {"m": {"n": 2}} END_STRICT_JSON {"o": 3}': ['{"m": {"n": 2}}'],
        "begin_strict_json nothing end_strict_json {\"o\": 3}": ['{"o": 3}'],
        "} } {": [],
        '[{"a": 1}, {"b": 2}]': ['{"a": 1}', '{"b": 2}'],
        "\\{ {\"p\": \"c:\\\\\"}": ['{"p": "c:\\\\"}'],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", io.json_objects(F.col("text")).alias("found")).collect()
    assert {r.text: r.found for r in rows} == cases
    for found in cases.values():
        for text in found:
            json.loads(text)


def test_long_answers_are_scanned_once():
    import time

    began = time.time()
    assert len(io.scan_objects("prose { " + '{"a": [1, "x}", {"b": 2}]}' * 100_000)) == 0
    assert len(io.scan_objects('{"a": [1, "x}", {"b": 2}]} and ' * 100_000)) == 100_000
    assert time.time() - began < 20


def test_records_do_not_change_the_schema(spark, tmp_path):
    from pyspark.sql.types import StructType

    rows = spark.createDataFrame([(1, "a")], "n long, t string")
    io.write_records(rows, str(tmp_path / "r"))
    schema = StructType(rows.schema.fields)
    good, bad = io.read_records(spark, str(tmp_path / "r"), schema)
    assert good.columns == ["n", "t"] == schema.names and good.count() == 1 and bad.count() == 0
