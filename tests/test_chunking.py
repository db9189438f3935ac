"""Chunking on small documents."""

import pytest
from pyspark.sql import functions as F

from regspark.functions import text as tx
from regspark.operators import chunking as ch

DOCS = "source_id string, instrument_type string, jurisdiction string, full_text string"


def chunks(spark, source, kind, text):
    df = spark.createDataFrame([(source, kind, "EU", text)], DOCS)
    return ch.chunk_corpus(df).orderBy("chunk_index").collect()


def test_articles_get_their_labels(spark):
    got = chunks(spark, "gdpr", "statute", "Article 1\nOne.\nArticle 2\nTwo.\nArticle 3\nThree.")
    assert [c.article for c in got] == ["Article 1", "Article 2", "Article 3"] and [c.chunk_index for c in got] == [0, 1, 2]
    assert [c.article for c in chunks(spark, "fadp", "statute", "Art. 1\nOne.\nArt. 2\nTwo.")] == ["Art. 1", "Art. 2"]


def test_preamble_and_recitals(spark):
    words = " ".join(["word"] * 50)
    got = chunks(spark, "other", "statute", f"{words}\nArticle 1\nBody")
    assert got[0].article is None and got[0].paragraph == "Preamble" and got[1].article == "Article 1"
    got = chunks(spark, "gdpr", "statute", f"lost\n(1) {words}\n(2) {words}\nArticle 1\nBody")
    assert [c.paragraph for c in got] == ["Recital 1", "Recital 2", None]
    assert chunks(spark, "other", "statute", "short\nArticle 1\nBody")[0].article == "Article 1"


def test_long_articles_split_by_paragraph_and_window(spark):
    para = " ".join(["word"] * 150)
    text = "Article 1\n" + "\n".join(f"{i}. {para}" for i in range(1, 6))
    got = chunks(spark, "gdpr", "statute", text)
    assert [c.paragraph for c in got] == ["1", "2", "3", "4", "5"] and {c.article for c in got} == {"Article 1"}
    got = chunks(spark, "gdpr", "statute", "Article 1\n" + " ".join(["word"] * 1000))
    assert len(got) == 3 and all(len(c.text.split()) <= 393 for c in got)


def test_cross_references_without_the_own_label(spark):
    got = chunks(spark, "gdpr", "statute", "Article 1\nAs provided in Article 6(1) and Art. 9.\nArticle 6\nThis Article 6 applies.")
    assert got[0].cross_references == ["Art. 9", "Article 6(1)"] and got[1].cross_references == []


def test_headings_carry_forward(spark):
    text = "CHAPTER I\nSection 1\nArticle 1\nA\nArticle 2\nB\nCHAPTER II\nArticle 3\nC"
    got = chunks(spark, "gdpr", "statute", text)
    assert [(c.chapter, c.section) for c in got] == [("CHAPTER I", "Section 1"), ("CHAPTER I", "Section 1"), ("CHAPTER II", "Section 1")]


def test_guidance_by_headings_or_windows(spark):
    got = chunks(spark, "g", "guidance", "1 Introduction\ntext\n2.1 Scope\nmore")
    assert [c.section for c in got] == ["1", "2.1"]
    got = chunks(spark, "g", "guidance", " ".join(["flat"] * 900))
    assert len(got) > 1 and all(len(c.text.split()) * 1.3 <= 562 for c in got)


def test_table_of_contents(spark):
    body = " ".join(["word"] * 30)
    df = spark.createDataFrame([("g", "guidance", "EU", f"skip Beta {body} Alpha {body} Gone", ["Alpha", "Beta", "Missing"])], DOCS + ", toc array<string>")
    got = ch.numbered_chunks(ch.guidance_chunks(df)).collect()
    assert [c.section for c in got] == ["Beta", "Alpha"]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (10, [10]), (393, [393]), (394, [393, 50]), (1125, [393, 393, 393, 93]), (1469, [393, 393, 393, 393, 93])])
def test_windows_cover_all_words(spark, n, sizes):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "t string").select(ch.windows(F.col("t")).alias("w"))
    got = [w.split() for w in df.first().w]
    assert [len(w) for w in got] == sizes
    assert all(a[-49:] == b[:49] for a, b in zip(got, got[1:], strict=False)) and {x for w in got for x in w} == {f"w{i}" for i in range(n)}


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="overlap"):
        ch.window_sizes(64, 64)


def test_null_and_empty_texts_give_no_chunk(spark):
    df = spark.createDataFrame([("a", "statute", "EU", None), ("b", "guidance", "EU", ""), ("c", None, None, " ")], DOCS)
    assert ch.chunk_corpus(df).count() == 0


def test_scalars(spark):
    import uuid

    r = spark.sql("SELECT 'Hello, WORLD  a-b é!' AS t, 'x:1' AS n, 'See Article 6(1) point (a) and Art. 9a' AS r").select(
        tx.normalised(F.col("t")).alias("norm"), tx.uuid5(F.col("n")).alias("id"), F.array_join(tx.cross_references(F.col("r")), "|").alias("refs"), tx.article_number(F.lit("Art.\n 9a")).alias("num"),
        tx.estimate_tokens(F.col("t")).alias("tokens"), tx.has_footnote(F.lit("text,12 more")).alias("foot"), tx.truncated(F.lit("abcdef"), 3).alias("cut"),
    ).first()
    assert r.norm == "hello world a-b é" and r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x:1")) and r.refs == "Art. 9a|Article 6(1) point (a)"
    assert (r.num, r.tokens, r.foot, r.cut) == ("9a", 5, True, "abc...")


def test_headings_in_the_last_characters_whatever_parts_they_are_in(spark):
    """A heading counts within 500 characters before an article, be these one part, a few or many."""
    for n, size in ((2, 600), (6, 150), (40, 20), (200, 0)):
        lines = ["CHAPTER I"] + [f"Article {i}" + " " + "x" * size for i in range(1, n + 1)]
        text = "\n".join(lines)
        d = spark.createDataFrame([("s", text)], "source_id string, full_text string")
        got = [r.chapter for r in ch.headed_spans(d).select(F.explode("_spans").alias("s")).select("s.chapter").collect()]
        assert len(got) == n and got[0] == "CHAPTER I" and set(got) == {"CHAPTER I"}
    late = "CHAPTER I\n" + "y" * 495 + "\nArticle 1 text\nCHAPTER II\nArticle 2 z"
    d = spark.createDataFrame([("s", late)], "source_id string, full_text string")
    assert [r.chapter for r in ch.headed_spans(d).select(F.explode("_spans").alias("s")).select("s.chapter").collect()] == [None, "CHAPTER II"]
