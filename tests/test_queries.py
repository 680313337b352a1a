"""Every registered query against its SQL, and what no plan may contain."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "documents embeddings labels conversations events pages benchmark".split()
# The queries of the training-data operators have their own tests.
QUERIES, ORACLE = driver.CORE_QUERIES, driver.CORE_ORACLE


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    # ROUGE-Lsum of whole documents fills tables too large for SQL; tests/test_overlap.py has the definitions instead.
    assert set(QUERIES) - set(ORACLE) == {"scored_summaries"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = sql.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(names) == columns
    assert len(got) > 0
    assert ordered(got) == ordered(expected)


def test_entry(spark):
    df = driver.entry(spark)
    assert {"company", "model", "rouge1", "rouge2", "rougel", "rougelsum", "bleu"} <= set(df.columns)
