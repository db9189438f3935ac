"""Blocks of positioned spans: made in their own row, and grouped where several rows bring one document."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from regspark.operators import tables as tb
from regspark.plans.text_queries import block_aggregate


def expected(rows):
    words = collections.defaultdict(list)
    for k, text in rows:
        for i, w in enumerate((text or "").split(" ")):
            if w:
                words[k, i // 3].append((i, w))
    out = []
    for (k, block), found in words.items():
        ws = [w for _, w in sorted(found)]
        if not "\n".join(ws).strip(" \t\n\x0b\f\r"):
            continue
        even, bold = sum(len(w) % 2 == 0 for w in ws), sum(len(w) > 5 for w in ws)
        size = round(sum(map(len, ws)) / len(ws), 4)
        out.append((k, block, hashlib.md5("\n".join(ws).encode()).hexdigest(), size, "A" if 2 * even >= len(ws) else "B", 2 * bold > len(ws)))
    return sorted(out, key=str)


def made(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    df = block_aggregate(spark, str(folder))
    return df, sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts():
    r = random.Random(5)
    words = ["a", "bb", "ccc", "twelve", "sevenths", "é́", "中文字", "\U0001f600", "\n", "x\ny", "", "", "\t", "$1", "\\"]
    return [None, "", " ", "   ", "\n", "a b c", "a b c ", " a b c", "a  b   c    d", "one", "  \n  \n  \n "] + [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(40)]


def test_blocks_of_odd_texts(spark, tmp_path):
    rows = list(enumerate(odd_texts())) + [(None, "a null id is one too")]
    assert made(spark, tmp_path, rows)[1] == expected(rows)


def test_blocks_of_repeated_documents(spark, tmp_path):
    """Rows of one id make blocks together, those of the null id as well; equal places take the lesser word first."""
    rows = list(enumerate(odd_texts())) + [(11, odd_texts()[11]), (12, "other words stand here now"), (None, "x y z"), (None, "x y z w")]
    assert made(spark, tmp_path, rows)[1] == expected(rows)


def test_blocks_of_unrepeated_documents_do_not_move(spark, tmp_path):
    """Only rows of ids that occur again are dealt by block."""
    df, got = made(spark, tmp_path, [(1, "a b c d"), (2, "e f g"), (2, "e f g")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("Project") if "hashpartitioning(doc_id" in x]
    assert len(got) == 3 and "LeftAnti" in plan and dealt and not any("LeftAnti" in x for x in dealt) and plan.index("LeftAnti") < plan.index("hashpartitioning")


def test_a_block_in_its_row_equals_the_grouped_one(spark):
    rows = [(1, 0, "a", 1.5, "X", True), (1, 1, "b", None, "Y", None), (1, 2, None, 2.5, None, False), (2, 0, "c", 3.0, None, None), (3, 0, "d", 1.0, "Z", True), (3, 1, "e", 2.0, "Y", True)]
    d = spark.createDataFrame(rows, "k long, span int, text string, size double, font string, bold boolean").coalesce(1)
    nested = d.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("span", "text", "size", "font", "bold"))).alias("spans")).select("k", *tb.own_block(F.col("spans")))
    rowsof = lambda x: sorted(map(tuple, x.collect()))
    assert rowsof(nested) == rowsof(tb.blocks(d, ["k"]))
