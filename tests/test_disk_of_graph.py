"""What queries put on disk: compressed tables, and only those that they need."""

import duckdb
import pytest

import __spark_entry__ as entry
from regspark.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def built(monkeypatch):
    kept = {}
    monkeypatch.setattr(tables, "_KEPT", kept)
    return lambda: {name for _, name, _ in kept}


def rows_of(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_obligations_are_written_without_the_rest_of_the_graph(spark, built):
    got, want = rows_of(spark, "load_obligations")
    assert got == want and got
    assert built() == {"chunks", "articles", "obligations"}


def test_stored_tables_are_compressed_well(spark):
    d = tables.stored(spark.range(10).selectExpr("cast(id as string) as x"), "small")
    assert d.inputFiles() and all(".zstd." in f for f in d.inputFiles()) and d.count() == 10


def test_no_text_of_the_graph_is_stored_twice(spark, built):
    got, want = rows_of(spark, "prompt_context")
    assert got == want and got
    assert "nodes" not in built() and {"chunks", "articles", "definitions", "obligations", "edges"} <= built()


def test_only_what_is_shown_of_texts_is_moved(spark):
    from regspark.operators import context as cx

    edges = [("a", f"o{i}", "IMPOSES") for i in range(7)] + [("a", "d", "DEFINES")] + [("a", f"b{i:02}", "REFERENCES") for i in range(12)]
    nodes = [("a", "Article")] + [(f"b{i:02}", "Article") for i in range(12)] + [(f"o{i}", "Obligation") for i in range(7)] + [("d", "Definition")]
    n = spark.createDataFrame(nodes, "node_id string, kind string").selectExpr("*", "'t' AS term", "repeat('x', 500) AS definition_text", "repeat('y', 300) AS description", "'duty' AS obligation_type")
    r = cx.article_parts(spark.createDataFrame([("a",)], "ref string"), spark.createDataFrame(edges, "src string, dst string, type string"), n, cx.IN_PROMPT).first()
    assert (r.n_obligations, len(r.obligations), r.n_references, len(r.references)) == (7, 5, 12, 10)
    assert {len(x.description) for x in r.obligations} == {150} and [len(x.definition_text) for x in r.definitions] == [200]
    assert [x.other for x in r.obligations] == [f"o{i}" for i in range(5)] and list(r.references) == [f"b{i:02}" for i in range(10)]
