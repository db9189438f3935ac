"""Definitions are listed over all documents, numbered in each source, and never in one task."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["list_definitions", "list_all_definitions"])
def test_listed_definitions_match_their_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = entry.queries()[name](spark, DATA)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString() and "exchange singlepartition" not in got._jdf.queryExecution().toString().lower()
    rows = [(r.source_id, r.term, r.place) for r in got.collect()]
    want = db.execute(f"SELECT source_id, term, place FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(rows) == sorted(want) and rows
    if name == "list_all_definitions":
        assert rows == sorted(rows) and len({r[0] for r in rows}) > 50


def test_listed_definitions_number_the_terms_of_a_source(spark, tmp_path):
    spark.createDataFrame([(7, "b x"), (7, "a y"), (7, "b z"), (8, "c"), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entry.queries()["list_all_definitions"](spark, str(tmp_path)).collect()]
    assert got == [("doc7", "a", 1), ("doc7", "b", 2), ("doc8", "c", 1)]
