"""The driver's contract: names, flagship, and a few queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


@pytest.mark.parametrize("name", ["vector_topk_filtered", "chunk_corpus", "references", "graph_stats", "retrieval_by_category", "interpret_article_refs", "answer_summary", "word_error_rate", "upsert_nodes"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = db.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    place = {c[0]: i for i, c in enumerate(want.description)}

    def row(values):
        return tuple(round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in values)

    assert sorted((row(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((row(r[place[c]] for c in columns) for r in want.fetchall()), key=repr)
