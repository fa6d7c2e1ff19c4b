"""Equality of a Spark result and a DuckDB result: names, values, any order of rows."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    cols = sorted(frame.columns)
    shown = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in shown.itertuples(index=False))


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    a, b = rows(spark_frame), rows(duck_frame)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]][:3] == []
