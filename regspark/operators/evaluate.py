"""Evaluation: retrieval, answers, transcripts and extraction against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx


def retrieval_scores(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """P@5, P@10 and reciprocal rank, rounded to 4, of rows (keys, rank, relevant); precision divides by k always."""
    hit = F.col("relevant")
    out = {f"precision_at_{k}": F.round(F.count_if(hit & (F.col("rank") <= k)) / F.lit(float(k)), 4) for k in (5, 10)}
    return ranked.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items()), F.round(F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 4).alias("reciprocal_rank"))


def costs(rows: DataFrame, prices: DataFrame, name: str = "cost_usd") -> DataFrame:
    """Adds what each row (model, input_tokens, output_tokens) cost by the price table (model, per_million_input, per_million_output).

    Rows of a model without a price have a null cost.  The models, a handful of rows, decide nothing but this column.
    """
    p = prices.select("model", F.col("per_million_input").alias("_in"), F.col("per_million_output").alias("_out"))
    cost = (F.col("input_tokens") * F.col("_in") + F.coalesce(F.col("output_tokens"), F.lit(0)) * F.col("_out")) / 1e6
    return rows.join(p, "model", "left").withColumn(name, cost).drop("_in", "_out")


def _mean(value: Column, digits: int, where: Column | None = None) -> Column:
    x = value.cast("double") if where is None else F.when(where, value.cast("double"))
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), digits)


def retrieval_summary(scores: DataFrame, by_category: bool = False) -> DataFrame:
    """Means per model, and with `by_category` per (model, category) too, in one pass (category null: all).

    Scores to four places; latency to one and cost to eight, where the rows have latency_ms and cost_usd.
    """
    means = [F.round(F.avg(c), 4).alias(c) for c in ("precision_at_5", "precision_at_10", "reciprocal_rank")]
    means += [_mean(F.col(c), digits).alias(f"avg_{c}") for c, digits in (("latency_ms", 1), ("cost_usd", 8)) if c in scores.columns]
    if not by_category:
        return scores.groupBy("model").agg(*means)
    return scores.groupingSets([["model"], ["model", "category"]], "model", "category").agg(*means)


def unpivoted(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """(chunk_id, source_id, field, value): a row for each of the fields, lists joined by spaces, null as an empty text; and one of no field."""
    kinds = dict(chunks.dtypes)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ") if kinds[c].startswith("array") else F.col(c).cast("string")
    pairs = [F.struct(F.lit(c).alias("field"), F.coalesce(text(c), F.lit("")).alias("value")) for c in fields]
    pairs.append(F.struct(F.lit("").alias("field"), F.lit("").alias("value")))
    return chunks.select("chunk_id", "source_id", F.explode(F.array(*pairs)).alias("p")).select("chunk_id", "source_id", "p.*")


def relevance_levels(rules: DataFrame, chunks: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, chunk_id, level): the first rule of a query, in order, that a chunk meets.

    A rule (query_id, rule_order, level, rule_source, match_field, pattern) is met where its source is the chunk's
    or null and its pattern is found in its field.  `fields` are those that rules may name; a rule of any other
    field tests an empty text.  Rules join chunks by field before any pattern is tried.
    """
    r = rules.withColumn("field", F.when(F.col("match_field").isin(fields), F.col("match_field")).otherwise(""))
    met = unpivoted(chunks, fields).join(r, "field").where((F.col("rule_source").isNull() | (F.col("rule_source") == F.col("source_id"))) & F.expr("regexp_like(value, pattern)"))
    return met.groupBy("query_id", "chunk_id").agg(F.min_by("level", "rule_order").alias("level"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Adds citation precision and recall (3 decimals), expressed_uncertainty and calibration_correct.

    Rows have (response_text, expected array, evidence_sufficient).
    """
    d = answers.withColumn("found", tx.citations(F.col("response_text"))).withColumn("expressed_uncertainty", tx.says_any(F.col("response_text"), tx.UNCERTAINTY))
    return d.select(
        "*", F.round(sc.citation_precision(F.col("found"), F.col("expected")), 3).alias("citation_precision"), F.round(sc.citation_recall(F.col("found"), F.col("expected")), 3).alias("citation_recall"),
        (F.col("expressed_uncertainty") != F.col("evidence_sufficient")).alias("calibration_correct"),
    )


def answer_summary(scores: DataFrame, key: str = "model") -> DataFrame:
    """Means per model to three places: citations over well-evidenced questions, calibration over all, uncertainty by evidence.

    Latency to one place and cost to six, where the rows have latency_ms and cost_usd.
    """
    well, unsure = F.col("evidence_sufficient"), F.col("expressed_uncertainty").cast("int")
    more = [_mean(F.col(c), digits).alias(f"avg_{c}") for c, digits in (("latency_ms", 1), ("cost_usd", 6)) if c in scores.columns]
    return scores.groupBy(key).agg(
        _mean(F.col("citation_precision"), 3, well).alias("citation_precision"), _mean(F.col("citation_recall"), 3, well).alias("citation_recall"),
        _mean(F.col("calibration_correct").cast("int"), 3).alias("calibration"), _mean(unsure, 3, ~well).alias("insufficient_rate"), _mean(unsure, 3, well).alias("false_refusal_rate"), *more,
    )


def transcript_summary(scores: DataFrame) -> DataFrame:
    """Means per (model, preprocessing, context_biasing) of rows (wer, entity_wer, fabricated, latency_ms, category), and those of categories A and B; 0 without rows."""
    a, b = F.col("category") == "A", F.col("category") == "B"
    return scores.groupBy("model", "preprocessing", "context_biasing").agg(
        _mean(F.col("wer"), 4).alias("avg_wer"), _mean(F.col("entity_wer"), 4).alias("avg_entity_wer"), _mean(F.col("fabricated"), 2).alias("avg_fabricated"), _mean(F.col("latency_ms"), 1).alias("avg_latency_ms"),
        _mean(F.col("wer"), 4, a).alias("cat_a_wer"), _mean(F.col("wer"), 4, b).alias("cat_b_wer"), _mean(F.col("entity_wer"), 4, b).alias("cat_b_entity_wer"),
    )


def ms_per_page(documents: DataFrame) -> DataFrame:
    """(source_id, ms_per_page) of documents with pages and total_ms; a document without pages counts as one page."""
    return documents.select("source_id", F.round(F.col("total_ms") / F.greatest(F.lit(1), F.col("pages")), 2).alias("ms_per_page"))


def transcript_scores(rows: DataFrame) -> DataFrame:
    """Adds wer, entity_wer and fabricated to rows (ground_truth, transcription, entities)."""
    truth, heard = tx.words(tx.normalised(F.col("ground_truth"))), tx.words(tx.normalised(F.col("transcription")))
    low_truth, low_heard = F.lower("ground_truth"), F.lower("transcription")
    tokens = lambda e: tx.words(F.lower(e))
    wanted = F.flatten(F.transform(F.filter("entities", lambda e: F.contains(low_truth, F.lower(e))), tokens))
    got = F.flatten(F.transform("entities", lambda e: F.when(F.contains(low_heard, F.lower(e)), tokens(e)).otherwise(F.filter(tokens(e), lambda t: F.contains(low_heard, t)))))
    d = rows.withColumn("_t", truth).withColumn("_h", heard).withColumn("_w", wanted).withColumn("_g", got)
    entity = F.when(F.size("_w") == 0, 0.0).when(F.size("_g") == 0, 1.0).otherwise(sc.word_error_rate(F.col("_w"), F.col("_g")))
    return d.select(*rows.columns, sc.word_error_rate(F.col("_t"), F.col("_h")).alias("wer"), entity.alias("entity_wer"), sc.fabricated(F.col("_t"), F.col("_h")).alias("fabricated"))


def _share(documents: DataFrame, truth: DataFrame, column: str, holds: Callable[[Column], Column], name: str) -> DataFrame:
    """Per document the share of its truth values that hold; 1 without any. The values meet each text once."""
    own = truth.where(F.col(column).isNotNull()).groupBy("source_id").agg(F.collect_list(column).alias("_own"))  # annotations of one document
    d = documents.select("source_id", "full_text").join(own, "source_id", "left")
    return d.select("source_id", F.coalesce(F.size(F.filter("_own", lambda n: F.coalesce(holds(n), F.lit(False)))) / F.size("_own"), F.lit(1.0)).alias(name))


def named_share(documents: DataFrame, truth: DataFrame, column: str, name: str) -> DataFrame:
    """The share of a document's numbers that its text names as 'Article n' or 'Art. n'; 1 without any."""
    says = lambda n: F.contains(F.col("full_text"), F.concat(F.lit("Article "), n)) | F.contains(F.col("full_text"), F.concat(F.lit("Art. "), n))
    return _share(documents, truth, column, says, name)


def footnote_rate(documents: DataFrame, truth: DataFrame) -> DataFrame:
    return _share(documents, truth, "note", lambda n: F.contains(F.col("full_text"), F.substring(n, 1, 30)), "footnote_rate")


def table_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document the mean over its true tables (source_id, page, table_id, cells) of the best cell recall among found tables (source_id, page, rows)."""
    flat = lambda c: F.filter(F.transform(F.flatten(c), lambda x: F.lower(tx.strip(x))), lambda x: x != "")
    d = truth.join(found.select("source_id", "page", "rows"), ["source_id", "page"], "left").withColumn("_e", flat("cells")).withColumn("_f", F.coalesce(flat("rows"), F.array().cast("array<string>")))
    share = F.when((F.size("_f") == 0) | (F.size("cells") == 0), 0.0).when(F.size("_e") == 0, 1.0).otherwise(F.size(F.filter("_e", lambda x: F.array_contains("_f", x))) / F.size("_e"))
    best = d.withColumn("_s", share).groupBy("source_id", "page", "table_id").agg(F.max("_s").alias("best"))
    return best.groupBy("source_id").agg(F.round(F.avg("best"), 4).alias("table_recall"))
