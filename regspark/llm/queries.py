"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from . import conversation_repair as repair
from .decontaminate import contamination, contamination_digest
from .jaccard_join import jaccard_components
from .licenses import license_scan
from .packing import pack_sequences
from . import periodic_runs as periodic
from . import quality_rules as rules
from .pii import pseudonyms
from .quality_model import quality_scores
from .simhash import near_duplicates
from .substring_dedup import cut_repeats
from .token_counts import count_tokens
from .url_filter import url_verdicts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.periodic_runs(periodic.damaged(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair_digest(rows, repair.damaged(rows))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_simhash, op3_pii_surrogates, op4_token_counts, op5_url_filters, op6_suffix_dedup, op7_quality_rules, op8_quality_classifier,
        op9_decontamination, op10_packing, op11_periodic_runs, op12_conversation_repair, op13_jaccard_join,
    )
}

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": rules.SQL, "op11_periodic_runs": periodic.SQL, "op12_conversation_repair": repair.SQL}
