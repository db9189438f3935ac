"""The pipeline on odd rows, clashing columns and empty tables."""

import corpus_pipeline as cp

from .conftest import DOCUMENT, prose


def write(spark, path, documents) -> str:
    documents.write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 30)), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_go_through_all_stages(spark, tmp_path, rows):
    more = [(1000 + i, prose(100 + i, 80) if i % 2 else "### $$$ %%% " * 20, "en", "s", None, i, "h", 1, "w", "h", "t", 0, "words") for i in range(40)]
    null_ids = [(None, t, None, None, None, None, None, None, None, None, None, None, None) for t in (prose(300, 60), prose(300, 60), None, "")]
    hit = (5000, prose(301, 40) + " " + prose(900, 30) + " mail a.b@m.example.com", "en", "s", 1, 1, "h", 1, "w", "h", "t", 0, "words")
    folder = write(spark, tmp_path, spark.createDataFrame([*rows, *more, *null_ids, hit], DOCUMENT).repartition(3))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        docs = cp.written(stage(spark, docs, folder), f"odd{k}")
        assert docs.columns == DOCUMENT.replace(",", "").split(" ")[::2]
    kept = docs.collect()
    assert {r.doc_id for r in kept} <= given and sum(r.doc_id is None for r in kept) == 4
    assert len([r for r in kept if r.doc_id is not None]) == len({r.doc_id for r in kept} - {None})
    text = next(r.text for r in kept if r.doc_id == 5000)
    assert prose(900, 30) not in text and "a.b@m" not in text and prose(301, 40) in text
    packed = cp.pack(spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept}


def test_empty_tables(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
