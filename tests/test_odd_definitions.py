"""Definitions of texts that begin oddly: every row that the SQL has."""

import duckdb

import __spark_entry__ as entry

TEXTS = (
    None, "", " ", "  two", " led by a space", "\n", "\n x", "\nled", "word", "word\n", "word\n\n next", "word\t next", "a;", "a;;\n ;", ";", "; x", "'quoted' x", "don't x;", "‘a’ x ; ; ", "'", "l’", "''x y",
    "x\na.\ny z", "x\nb.\nmeans\ny z", "means means means", "x\nmeans\ny z;", "In this\na. b means c", "\x0b x", "x\x0b", "x\x0b ;\x0b", "x;\u0085", "x; ", "Éa, ñ", "x " + "y" * 600, "x\r\n y\r\n", "1. 'a' means b", "\t\tx y",
)


def test_definitions_of_odd_texts_match_their_sql(spark, tmp_path):
    ids = [*range(-2, 3), None]
    rows = [(None if i is None else i + 10 * n if i >= 0 else i - 10 * n, t) for n, t in enumerate(TEXTS) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [(r.node_id, r.term, r.definition_md5) for r in entry.queries()["extract_definitions"](spark, str(tmp_path)).collect()]
    want = db.execute(f"SELECT node_id, term, definition_md5 FROM ({entry.oracle_sql()['extract_definitions']})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > len(TEXTS)


def test_a_null_text_and_one_that_begins_with_a_space_have_their_items(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, None), (3, " x"), (4, " x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.node_id, r.term, r.definition_md5 is None) for r in entry.queries()["extract_definitions"](spark, str(tmp_path)).collect())
    assert got == [("doc1:def:a", "a", True), ("doc1:def:b", "b", True), ("doc3:def:a", "a", False), ("doc3:def:b", "b", False)]
