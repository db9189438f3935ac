"""Questions: the articles they name, the filters they imply, and what follows from their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of article references, and keywords with the filter they stand for.
REFERENCE_FIRST = r"(?i)\b(GDPR|FADP)\s+(?:Article|Art\.?)\s*(\d+)"
NUMBER_FIRST = (r"(?i)\b(?:Article|Art\.?)\s*(\d+)\s+(?:of\s+(?:the\s+)?)?(GDPR|FADP)",)
JURISDICTIONS = (("gdpr", "EU"), ("eu", "EU"), ("european", "EU"), ("fadp", "CH"), ("swiss", "CH"), ("switzerland", "CH"), ("fdpic", "CH"), ("edpb", "EU"))
SOURCES = (("gdpr", "gdpr"), ("fadp", "fadp"), ("fdpic", "fdpic_technical_measures"))


def article_refs(question: Column) -> Column:
    """References as source:label, by pattern and then place, each once."""

    def label(source: Column, number: Column) -> Column:
        return F.concat(F.when(F.lower(source) == "gdpr", "gdpr:Article ").otherwise("fadp:Art. "), number)

    def pairs(pattern: str, source: int, number: int) -> Column:
        return F.zip_with(F.regexp_extract_all(question, F.lit(pattern), F.lit(source)), F.regexp_extract_all(question, F.lit(pattern), F.lit(number)), label)

    return F.array_distinct(F.concat(pairs(REFERENCE_FIRST, 1, 2), *(pairs(p, 2, 1) for p in NUMBER_FIRST)))


def keyword_filters(question: Column, keywords: tuple[tuple[str, str], ...]) -> Column:
    """What the keywords found as substrings stand for, in their order, each once."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.array_distinct(F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in keywords)), lambda x: x.isNotNull()))


def input_route(mode: Column, audio_path: Column) -> Column:
    return F.when((mode == "audio") & (F.coalesce(audio_path, F.lit("")) != ""), "audio").otherwise("text")


def list_filter(values: Column, column: Column) -> Column:
    """True for an empty list, else membership."""
    return (F.size(values) == 0) | F.array_contains(values, column)


def seeds_of_hits(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, ref, place): the first distinct articles of the hits (query_id, rank, source_id, article) by rank."""
    named = hits.where("article is not null and article <> ''").select("query_id", "rank", F.concat_ws(":", "source_id", "article").alias("ref"))
    first = named.groupBy("query_id", "ref").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ref"))).where(F.col("place") <= most).drop("rank")


def seeds_of_questions(questions: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, ref, place, named): the articles that a question (query_id, refs) names, in its order; only for those that name none, the first of their hits."""
    named = questions.select("query_id", F.posexplode("refs").alias("place", "ref")).select("query_id", "ref", (F.col("place") + 1).alias("place"), F.lit(True).alias("named"))
    silent = questions.where(F.size("refs") == 0).select("query_id")
    found = seeds_of_hits(hits.join(silent, "query_id", "left_semi"), most)
    return named.unionByName(found.select("query_id", "ref", "place", F.lit(False).alias("named")))


def status(questions: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, n_hits, n_items, confidence, errors, stages) of each question (query_id, question) from its prompt and answer."""
    from .context import confidence
    from ..functions.text import strip

    d = questions.select("query_id", "question").join(prompts, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    silent, blank = F.coalesce("question", F.lit("")) == "", strip(F.coalesce("prompt", F.lit(""))) == ""
    errors = F.filter(F.array(F.when(silent, "No search query available"), F.when(blank, "No context available for generation")), lambda x: x.isNotNull())
    stages = F.array(F.lit("interpret"), F.when(silent, "retrieve:error").otherwise("retrieve"), F.lit("expand_graph"), F.when(blank, "generate:error").otherwise("generate"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return d.select("query_id", count("n_passages").alias("n_hits"), count("n_items").alias("n_items"), confidence(F.col("prompt"), F.col("answer")).alias("confidence"), errors.alias("errors"), stages.alias("stages"))
