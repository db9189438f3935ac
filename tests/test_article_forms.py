"""Articles as their source writes them, and documents of very many articles."""

import time

import pytest
from pyspark.sql import functions as F

from regspark.operators import chunking as ch

COLUMNS = "source_id string, instrument_type string, jurisdiction string, full_text string"


def labels(spark, source: str, text: str) -> list[str]:
    d = spark.createDataFrame([(source, "statute", "EU", text)], COLUMNS)
    return [r.article for r in ch.chunk_corpus(d).where("article is not null").orderBy("chunk_index").collect()]


@pytest.mark.parametrize(
    ("source", "want"),
    [("gdpr", ["Article 1", "Article 2"]), ("fadp", ["Art. 3", "Art. 25a"]), ("other", ["Article 1", "Article 2", "Art. 3", "Art. 25a"])],
)
def test_each_source_has_its_form(spark, source, want):
    text = "Preamble\nArticle 1\nOne is here.\nArticle 2\nTwo is here.\nArt. 3\nThree is here.\nArt. 25a\nFour is here."
    assert labels(spark, source, text) == want


def test_a_letter_is_no_part_of_a_number(spark):
    """Where numbers have no letters, a line with one begins no article."""
    assert labels(spark, "gdpr", "Article 25a\nText.\nArticle 26\nText.") == ["Article 26"]
    assert labels(spark, "fadp", "Art. 25a\nText.\nArticle 26\nText.") == ["Art. 25a"]
    assert labels(spark, "law", "Article 25a\nText.\nArticle 26\nText.") == ["Article 25a", "Article 26"]


def test_headings_are_carried_and_looked_for_nearby(spark):
    far = "x " * 300
    text = f"CHAPTER I\nSection 1\nArticle 1\na\nArticle 2\nb\nCHAPTER II\nArticle 3\nc\nSection 2\n{far}\nArticle 4\nd\nCHAPTER III\nCHAPTER IV\nArticle 5\ne"
    d = spark.createDataFrame([("law", "statute", "EU", text)], COLUMNS)
    got = ch.headed_spans(d).select(F.explode("_spans").alias("s")).select("s.*").collect()
    assert [(r.label, r.chapter, r.section) for r in got] == [
        ("Article 1", "CHAPTER I", "Section 1"), ("Article 2", "CHAPTER I", "Section 1"), ("Article 3", "CHAPTER II", "Section 1"), ("Article 4", "CHAPTER II", "Section 1"), ("Article 5", "CHAPTER IV", "Section 1"),
    ]
    starts = ch.regex_spans(d).orderBy("position").collect()
    assert [text[r.start :].startswith(r.label) for r in starts] == [True] * 5 and "".join(r.span for r in starts) == text[starts[0].start :]


def test_twenty_thousand_articles(spark):
    text = "\n".join(f"Article {i}\nThe text of number {i} refers to Article {i % 7 + 1}." for i in range(1, 20_001))
    d = spark.createDataFrame([("law", "statute", "EU", text)], COLUMNS)
    begin = time.time()
    rows = ch.chunk_corpus(d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("article").alias("a"), F.max("chunk_index").alias("last")).first()
    assert (rows.n, rows.a, rows.last) == (20_000, 20_000, 19_999) and time.time() - begin < 60
