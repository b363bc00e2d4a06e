"""Every registered query against its SQL counterpart on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_file

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, SQL = entry_file.queries(), entry_file.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def shown(rows):
    return sorted(tuple("0.0" if x == 0 and isinstance(x, float) else str(x) for x in r) for r in rows)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    text = {name for name in QUERIES if name.startswith("op") and name[2:3].isdigit()} | {"pipeline"}
    assert set(QUERIES) - set(SQL) <= text


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = [[r[c] for c in columns] for r in df.collect()]
    answer = duck.sql(SQL[name])
    assert sorted(answer.columns) == columns
    types = dict(zip(answer.columns, map(str, answer.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    places = [answer.columns.index(c) for c in columns]
    assert shown(got) == shown([[r[i] for i in places] for r in answer.fetchall()])
    assert got


def test_sketched_bins_equal_exact_ones_on_small_data(spark, folder):
    exact = QUERIES["optbin_fit"](spark, folder).collect()
    sketched = QUERIES["optbin_sketch"](spark, folder).collect()
    assert shown(exact) == shown(sketched)


def test_entry(spark):
    rows = entry_file.entry(spark).collect()
    assert rows and all(math.isfinite(r["iv"]) for r in rows)
