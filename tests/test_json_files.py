"""Scans of JSON files: good ones, bad ones, none; page times in either unit; results written twice."""

import json

from regspark.sources import json_files as jf


def put(path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_chunks_of_good_files_and_errors_of_bad_ones(spark, tmp_path):
    put(tmp_path / "gdpr" / "chunks.json", [{"chunk_id": "a", "text": "é", "source_id": "gdpr", "chunk_index": 0, "cross_references": ["Article 1"]}, {"chunk_id": "b", "chunk_index": 1, "unknown": 5}])
    put(tmp_path / "fadp" / "chunks.json", "\n [ ] \n")
    put(tmp_path / "cut" / "chunks.json", '[{"chunk_id": "c"},')
    put(tmp_path / "object" / "chunks.json", {"chunk_id": "d"})
    put(tmp_path / "text" / "chunks.json", "no JSON")
    put(tmp_path / "empty" / "chunks.json", "")
    put(tmp_path / "other" / "notes.json", [{"chunk_id": "e"}])
    (tmp_path / "without").mkdir()
    rows, errors = jf.read_chunk_files(spark, f"{tmp_path}/*/chunks.json")
    assert sorted((r.chunk_id, r.text, r.folder) for r in rows.collect()) == [("a", "é", "gdpr"), ("b", None, "gdpr")]
    assert sorted(r.folder for r in errors.collect()) == ["cut", "object", "text"]  # a file of no bytes is passed over


def test_missing_folders_are_empty_tables(spark, tmp_path):
    for read in (jf.read_chunk_files, jf.read_obligation_files):
        assert all(t.count() == 0 for t in read(spark, f"{tmp_path}/nowhere"))
    tables, errors = jf.read_truth_files(spark, f"{tmp_path}/nowhere")
    assert errors.count() == 0 and all(t.count() == 0 for t in tables.values())
    assert all(t.count() == 0 for t in jf.read_page_files(spark, f"{tmp_path}/nowhere"))


def test_truth_is_named_by_its_file(spark, tmp_path):
    put(tmp_path / "law.json", {"articles": [{"number": "1", "title": "x", "paragraph_count": 2}], "tables": [], "footnotes": [{"page": 1, "marker": "1", "text": "n"}]})
    put(tmp_path / "named.json", {"document_id": "own", "articles": [{"number": "2"}]})
    put(tmp_path / "bad.json", [1, 2])
    tables, errors = jf.read_truth_files(spark, f"{tmp_path}", "*.json")
    assert sorted((r.document_id, r.number) for r in tables["articles"].collect()) == [("law", "1"), ("own", "2")]
    assert tables["footnotes"].count() == 1 and tables["cross_refs"].count() == 0 and [r.file for r in errors.collect()] == ["bad.json"]


def test_page_times_in_either_unit(spark, tmp_path):
    put(tmp_path / "a" / "pages.json", [{"page": 2, "content": "two", "processing_time_seconds": 1.5}, {"page": 1, "processing_time_ms": 20.0, "processing_time_seconds": 9.0}, {"page": 3, "content": "x"}])
    put(tmp_path / "a" / "extraction_summary.json", {"total_time_seconds": 2.5})
    put(tmp_path / "b" / "pages.json", [])
    put(tmp_path / "b" / "extraction_summary.json", {"total_time_seconds": 1, "total_processing_time_ms": 7.0})
    put(tmp_path / "c" / "pages.json", "broken")
    pages, documents = jf.read_page_files(spark, f"{tmp_path}")
    assert sorted((r.source_id, r.page, r.content, r.ms) for r in pages.collect()) == [("a", 1, "", 20.0), ("a", 2, "two", 1500.0), ("a", 3, "x", 0.0)]
    assert {r.source_id: (r.total_ms, r.error is None) for r in documents.collect()} == {"a": (2500.0, True), "b": (7.0, True), "c": (0.0, False)}


def test_results_written_again_are_the_same(spark, tmp_path):
    one = spark.createDataFrame([("m", 2, 0.123456), ("m", 1, None)], "model string, query_id int, score double")
    all_ = spark.createDataFrame([("m", 0.5)], "model string, avg double")

    def lines():
        return {name: sorted(x for f in (tmp_path / "out" / name).glob("part-*") for x in f.read_text().splitlines()) for name in ("individual", "aggregated")}

    jf.write_results(one, all_, f"{tmp_path}/out", ["model", "query_id"], {"score": 2})
    first = lines()
    jf.write_results(one.repartition(3), all_, f"{tmp_path}/out", ["model", "query_id"], {"score": 2})
    assert lines() == first == {"individual": ['{"model":"m","query_id":1,"score":null}', '{"model":"m","query_id":2,"score":0.12}'], "aggregated": ['{"model":"m","avg":0.5}']}
    read, _ = jf.read_results(spark, f"{tmp_path}/out", "model string, query_id int, score double", "model string, avg double")
    assert sorted((r.query_id, r.score) for r in read.collect()) == [(1, None), (2, 0.12)]


def test_truth_of_many_documents_in_a_file(spark, tmp_path):
    put(tmp_path / "many.json", [{"document_id": "a", "articles": [{"number": "1"}]}, {"document_id": "b", "articles": [{"number": "2"}, {"number": "3"}]}])
    put(tmp_path / "none.json", [])
    put(tmp_path / "bad.json", '[{"document_id": "c"},')
    tables, errors = jf.read_truth_files(spark, f"{tmp_path}", "*.json")
    assert sorted((r.document_id, r.number) for r in tables["articles"].collect()) == [("a", "1"), ("b", "2"), ("b", "3")]
    assert [r.file for r in errors.collect()] == ["bad.json"]


def test_files_get_more_and_not_longer(spark):
    """No file holds more documents than another size of table would give it, and those of an article are with its document's."""
    from pyspark.sql import functions as F

    from regspark.plans import file_queries as fq

    docs = spark.range(40_000).select(F.concat(F.lit("doc"), "id").alias("source_id"), F.concat(F.lit("doc"), "id", F.lit(":Article 3")).alias("src"))
    files = docs.select("*", fq._bundle().alias("one"), fq._bundle("src").alias("two"))
    assert files.where("one <> two").count() == 0
    assert files.groupBy("one").count().agg(F.max("count")).first()[0] == fq.IN_FILE
