"""The registered queries: SQL where there is any, names, and whole tables."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from yardstream.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLE[name]) == ""


def test_every_operator_is_registered_once():
    names = set(entry.queries())
    assert set(QUERIES) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name,table,key", [("op1_personal_data", "documents", "doc_id"), ("op4_language_id", "documents", "doc_id"), ("op5_quality", "documents", "doc_id"), ("op8_source_mix", "documents", "doc_id"), ("op12_toxicity", "documents", "doc_id")])
def test_every_row_has_a_result(spark, small, name, table, key):
    want = sorted(r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in QUERIES[name](spark, small).select(key).collect()) == want
