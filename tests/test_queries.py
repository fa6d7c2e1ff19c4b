"""Every registered query against its SQL, or for its shape where SQL can't express it."""

import os

import pytest
from compare import SF, same

from studyweave.plans import catalog, reward_queries

SQL = catalog.oracle_sql()
ONE_ROW = {"tag_coverage", "quality_report", "run_comparison", "preference_statistics"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF).toPandas()
    same(frame, duck.execute(SQL[name]).df())
    if len(frame) > 3:
        assert any(frame[c].astype(str).nunique() > 1 for c in frame.columns)


@pytest.mark.parametrize("name", sorted(reward_queries.REGISTRY.sql))
def test_scores_equal_sql_on_more_rows(spark, name):
    """Scores are rounded numbers of rounded numbers: many lie on a half, some only on a larger table."""
    import duckdb

    sf = os.path.join(os.path.dirname(SF), "sf0.01")
    con = duckdb.connect()
    for table in ("conversations", "events"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    same(catalog.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_and_varies(spark, name):
    frame = catalog.queries()[name](spark, SF).toPandas()
    assert len(frame)
    assert name in ONE_ROW or any(frame[c].astype(str).nunique() > 1 for c in frame.columns)


def test_entry_and_guard():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
