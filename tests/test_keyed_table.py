"""The merged table: results, costs, replays and batches that were cut off."""

import os
import random

import pytest

from regspark.sources.keyed import KeyedTable
from regspark.streaming import ingest

SCHEMA = "k string, place int, v string"


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("k", "place", "v").collect())


def size(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


@pytest.mark.parametrize("insert_only", [False, True])
def test_batches_equal_a_dictionary(spark, tmp_path, insert_only):
    """Replaced keys, tombstones, keys in both, empty batches, compaction in between."""
    r, table, want = random.Random(3), KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=5, insert_only=insert_only), {}
    assert table.read() is None
    for step in range(6):
        batch = {f"k{r.randrange(12)}": [(i, f"{step}.{i}") for i in range(r.randint(1, 3))] for _ in range(4 if step != 3 else 0)}
        gone = [f"k{r.randrange(12)}" for _ in range(3)]
        table.merge(spark.createDataFrame([(k, *x) for k, v in batch.items() for x in v], SCHEMA), step, spark.createDataFrame([(k,) for k in gone], "k string"))
        for k in {**{k: None for k in gone}, **batch}:
            if not insert_only or k not in want:
                want[k] = batch.get(k)
        expected = sorted((k, *x) for k, v in want.items() if v for x in v)
        assert rows(table.read()) == expected
        if step in (1, 4):
            table.compact()
            assert rows(table.read()) == expected and table.pending() == 0
            if insert_only:  # a tombstone that was compacted no longer holds its key
                want = {k: v for k, v in want.items() if v}


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=16)
    text = "words of some length that differ " * 3
    table.merge(spark.range(20_000).selectExpr("concat('k', id) AS k", "0 AS place", f"concat('{text}', sha2(string(id), 256)) AS v"), 0)
    table.compact()
    whole = size(f"{tmp_path}/t/base")
    table.merge(spark.createDataFrame([("k7", 0, "new"), ("k8", 0, "new")], SCHEMA), 1)
    assert size(f"{tmp_path}/t/delta/1") < whole / 100
    assert len(table.compact()) <= 2 and size(f"{tmp_path}/t/base/1") < whole / 4
    assert table.read().count() == 20_000 and table.read().where("v = 'new'").count() == 2


def test_replays_and_cut_off_batches(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"])
    table.merge(spark.createDataFrame([("a", 0, "old"), ("b", 0, "old")], SCHEMA), 0)
    batch = spark.createDataFrame([("a", 0, "new"), ("a", 1, "new"), ("c", 0, "new")], SCHEMA)
    before = rows(table.read())

    def killed(*_):
        raise InterruptedError

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", killed)
        with pytest.raises(InterruptedError):
            table.merge(batch, 1)
        assert rows(table.read()) == before  # written, but not listed
        with pytest.raises(InterruptedError):
            table.compact()
        assert rows(table.read()) == before
    for _ in range(3):  # the run that follows, and two replays
        table.merge(batch, 1)
        assert rows(table.read()) == [("a", 0, "new"), ("a", 1, "new"), ("b", 0, "old"), ("c", 0, "new")]
    table.compact()
    table.merge(batch, 1)
    assert rows(table.read()) == [("a", 0, "new"), ("a", 1, "new"), ("b", 0, "old"), ("c", 0, "new")]


def test_later_batches_may_have_more_columns(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"])
    table.merge(spark.createDataFrame([("a", 0, "x")], SCHEMA), 0)
    table.merge(spark.createDataFrame([("b", 0, "y", 5)], SCHEMA + ", more int"), 1)
    assert sorted((r.k, r.more) for r in table.read().collect()) == [("a", None), ("b", 5)]


def test_stream_over_batches_equals_one_run(spark, tmp_path, monkeypatch):
    from regspark.operators.chunking import chunk_corpus

    monkeypatch.setattr(ingest, "MOST", 2)
    schema, last = ingest.DOCUMENT, {}
    for step in range(5):
        new = {f"d{k}": (f"d{k}", "statute", "EU", f"Article 1\nold {step}\nArticle 2\nmore of {k}") for k in range(step, step + 3)}
        if step == 4:
            new["d1"] = ("d1", "statute", "EU", "")
        last |= new
        spark.createDataFrame(list(new.values()), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.chunk_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = ingest.chunk_table(spark, f"{tmp_path}/out")
    got = sorted((r.chunk_id, r.text) for r in found.read().collect())
    assert got == sorted((r.chunk_id, r.text) for r in chunk_corpus(spark.createDataFrame(list(last.values()), schema)).collect())
    assert found.pending() <= 2 and not [r for r in got if "d1" in r]
