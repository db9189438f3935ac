"""One block of the benchmark and many give the same rows."""

import pytest

from regspark.llm import decontaminate as dc

from .conftest import prose


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, prose(200 + i, 25)) for i in range(12)], "item_id long, text string")


def test_repeated_and_null_ids_with_many_blocks(spark, items, monkeypatch):
    hit = [prose(300, 10) + " " + prose(200 + i, 25) + " " + prose(201 + i, 25) for i in range(11)]
    rows = [(1, hit[0]), (1, hit[1]), (1, hit[1]), (None, hit[2]), (None, hit[3] + " " + prose(400, 9)), (None, None), (5, ""), (6, prose(500, 30)), (7, hit[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: sorted(map(repr, dc.contamination(docs, items).collect()))
    one = found()
    monkeypatch.setattr(dc.query_blocks, "__defaults__", (400,))
    assert len(list(dc.query_blocks(items, "item_id", "text"))) > 1 and found() == one and len(one) == len(rows)


def test_cuts_of_overlapping_items_with_many_blocks(spark, monkeypatch):
    w = prose(1, 400).split()
    benchmark = spark.createDataFrame([(k, " ".join(w[5 * k : 5 * k + 10])) for k in range(40)], "item_id long, text string")
    clean = [prose(50 + k, 12) for k in range(30)]
    rows = [(1, f"{clean[0]} {' '.join(w[:15])} {clean[1]}"), (None, f"{clean[2]} {' '.join(w[:40])} {clean[3]}"), (1, " ".join(w[20:60])), (2, clean[4]), (3, None), (4, "")]
    # what a cut joins is a passage of another item: clean words that must stay
    rows += [(10 + k, f"{clean[5]} {' '.join(w[5 * k : 5 * k + 4])} {' '.join(w[150:160])} {' '.join(w[5 * k + 4 : 5 * k + 10])} {clean[6]}") for k in range(0, 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = lambda: sorted(map(repr, dc.decontaminated(docs, benchmark).collect()))
    one = left()
    assert f"Row(doc_id=1, text={clean[0] + '  ' + clean[1]!r})" in one and len(one) == len(rows) - 1
    monkeypatch.setattr(dc.query_blocks, "__defaults__", (400,))
    assert len(list(dc.query_blocks(benchmark, "item_id", "text"))) > 1 and left() == one
