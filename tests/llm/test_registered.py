"""Registered queries as a whole: names, contracts' columns, and SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry_file
from riskloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_html_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_mixture_packing": dict.fromkeys(
        ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint"),
    "op5_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_quality_rules": dict.fromkeys(
        ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"
    ) | {"base_failed": "boolean", "kept": "boolean"},
    "op7_secret_scan": dict.fromkeys(("doc_id", "n_assign", "n_access", "n_hex"), "bigint")
    | {"base_sha256": "string", "spans": "string"},
    "op8_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_hard_negatives": dict.fromkeys(
        ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), "bigint") | {"rank": "int"},
    "op12_embedding_near_dedup": dict.fromkeys(("vec_id", "n_links", "component_id"), "bigint") | {"kept": "boolean"},
    "op13_spelling_variants": {"word": "string", "form": "string", "root": "string"}
    | dict.fromkeys(("n", "n_near", "form_n"), "bigint"),
    "op9_pu_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 14)]
    assert {*names, "pipeline"} <= set(entry_file.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_and_columns(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert COLUMNS.get(name, {}).items() <= types.items()
    tables = {"2": "pages", "4": "pages", "5": "embeddings", "11": "embeddings", "12": "embeddings"}
    table = tables.get(name[2:].split("_")[0], "documents")
    rows, there = df.count(), spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name[2] in "26789" or name[:4] in ("op10", "op12"):
        assert rows == there
    elif name.startswith("op4"):
        assert rows == 2 * there
    assert rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("embeddings", "documents"):
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = connection.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
