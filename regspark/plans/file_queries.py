"""Queries over JSON files that Spark writes from the given tables first: scans with error rows, and written results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources import json_files as jf
from ..sources.tables import new_folder, stored
from .common import Area
from .corpus import CHUNKS, GRAPH, LEGAL, SPANS, view, with_
from .graph_queries import Graph
from .search_queries import _MEANS, _PAID_SCORES, _paid

query = Area()
QUERIES, ORACLES = query.queries, query.oracles


#: Documents whose rows share a file: files get more, not longer, as the tables grow.
IN_FILE = 200


def _bundle(source: str = "source_id") -> Column:
    """The file of a document's rows, by the number in its name."""
    return F.floor(F.regexp_extract(source, r"\d+", 0).cast("long") / IN_FILE).alias("b")


def _spoiled(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Texts of some documents as files among the others: no JSON, cut off, or an object where a list should be."""
    d = view(spark, sf_dir, "documents").where("doc_id % 50 = 7 and text is not null")
    text = F.expr("CASE WHEN doc_id % 150 = 7 THEN text WHEN doc_id % 150 = 57 THEN concat('[{\"source_id\": \"doc', doc_id, '\"},') ELSE concat('{\"chunk_index\": ', doc_id, '}') END")
    d.select(text.alias("value")).write.option("maxRecordsPerFile", 1).mode("append").option("lineSep", "\n").text(folder)


_BAD = """bad AS (SELECT CASE WHEN doc_id % 150 = 7 THEN text WHEN doc_id % 150 = 57 THEN '[{"source_id": "doc' || doc_id || '"},' ELSE '{"chunk_index": ' || doc_id || '}' END AS t FROM documents WHERE doc_id % 50 = 7 AND text IS NOT NULL)"""


@query(
    with_(LEGAL, SPANS, CHUNKS, _BAD)
    + """SELECT source_id, chunk_index, coalesce(article, '') AS article, len(cross_references) AS n_refs, md5(text) AS text_md5, NULL AS error FROM refs
    UNION ALL SELECT NULL, NULL, NULL, NULL, md5(t || chr(10)), 'not a list of the expected form' FROM bad"""
)
def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, folder = Graph(spark, sf_dir).chunks, new_folder(spark, "chunk_files")
    item = F.struct("chunk_id", "text", "source_id", "instrument_type", "jurisdiction", "chapter", "section", "article", "paragraph", "cross_references", "chunk_index")
    jf.write_files(chunks.groupBy(_bundle()).agg(F.collect_list(item).alias("v")), folder, F.col("v"))
    _spoiled(spark, sf_dir, folder)
    rows, errors = jf.read_chunk_files(spark, folder, "*.txt")
    good = rows.select("source_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.coalesce("article", F.lit("")).alias("article"), F.size("cross_references").cast("long").alias("n_refs"), F.md5("text").alias("text_md5"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select(F.col("content_md5").alias("text_md5"), "error"), allowMissingColumns=True)


@query(
    with_(LEGAL) + """, l AS (SELECT *, len(string_split(full_text, chr(10))) AS n FROM legal)
    SELECT source_id AS document_id, 'articles' AS kind, CAST(k AS VARCHAR) AS a, title AS b FROM l, range(1, 4) r(k) UNION ALL
    SELECT source_id, 'tables', CAST(n AS VARCHAR), title FROM l UNION ALL SELECT source_id, 'cross_refs', 'Article 1', 'Article ' || n FROM l WHERE n > 1 UNION ALL SELECT source_id, 'footnotes', CAST(n AS VARCHAR), substr(full_text, 1, 30) FROM l"""
)
def scan_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "truth_files")
    d = Graph(spark, sf_dir).docs.withColumn("n", F.size(F.split("full_text", "\n")))
    truth = F.struct(
        F.col("source_id").alias("document_id"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(k.cast("string").alias("number"), F.col("title"), k.alias("paragraph_count"))).alias("articles"),
        F.array(F.struct(F.lit(1).alias("page"), F.col("n").alias("rows"), F.lit(1).alias("cols"), F.array(F.array("title")).alias("cells"))).alias("tables"),
        F.when(F.col("n") > 1, F.array(F.struct(F.lit("Article 1").alias("source_article"), F.concat(F.lit("Article "), "n").alias("target_article"), F.lit(1).alias("page")))).alias("cross_references"),
        F.array(F.struct(F.lit(1).alias("page"), F.col("n").cast("string").alias("marker"), F.substring("full_text", 1, 30).alias("text"))).alias("footnotes"),
    )
    alone = F.col("doc_id") % 50 == 0  # files of one document among those of many
    jf.write_files(d.where(~F.coalesce(alone, F.lit(False))).groupBy(_bundle()).agg(F.collect_list(truth).alias("v")), folder, F.col("v"))
    jf.write_files(d.where(alone), folder, truth, mode="append")
    t, _ = jf.read_truth_files(spark, folder, "*.txt")
    row = lambda kind, a, b: t[kind].select("document_id", F.lit(kind).alias("kind"), F.expr(a).alias("a"), F.expr(b).alias("b"))
    out = row("articles", "number", "title").unionByName(row("tables", "string(rows)", "cells[0][0]"))
    return out.unionByName(row("cross_refs", "source_article", "target_article")).unionByName(row("footnotes", "marker", "text"))


@query(with_(*GRAPH) + "SELECT i.article_node_id, o.node_id, o.obligation_type, md5(o.description) AS description_md5 FROM obligations o JOIN (SELECT DISTINCT article_node_id, node_id FROM imposed) i USING (node_id)")
def load_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, folder = Graph(spark, sf_dir), new_folder(spark, "obligation_files")
    node = F.struct("node_id", "description", "obligation_type", "source_id", F.lit("").alias("article_label"), "subject")
    edge = F.struct("article_node_id", F.col("node_id").alias("obligation_node_id"))
    # each obligation has one article, so a document's nodes and edges are in the same rows, and the graph's other tables are not needed
    files = graph.obligations.groupBy(_bundle()).agg(F.collect_list(node).alias("obligations"), F.collect_list(edge).alias("relationships"))
    jf.write_files(files, folder, F.struct("obligations", "relationships"))
    found, rels, _ = jf.read_obligation_files(spark, folder, "*.txt")
    said = found.select("node_id", "obligation_type", F.md5("description").alias("description_md5"))
    return rels.join(said, F.col("obligation_node_id") == F.col("node_id")).select("article_node_id", "node_id", "obligation_type", "description_md5")


@query(
    _PAID_SCORES + f""" SELECT 'individual' AS part, model, CAST(query_id AS VARCHAR) AS id, round(precision_at_5, 4) AS precision_at_5, CAST(reciprocal_rank AS DOUBLE) AS reciprocal_rank, coalesce(latency_ms, -1) AS latency_ms FROM paid
    UNION ALL SELECT 'aggregated', model, '', precision_at_5, reciprocal_rank, avg_latency_ms FROM (SELECT model, {_MEANS} FROM paid GROUP BY 1)"""
)
def save_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, paid = new_folder(spark, "results"), stored(_paid(spark, sf_dir), "paid")  # four steps read it
    for _ in range(2):  # written again, it is the same
        jf.write_results(paid, ev.retrieval_summary(paid), folder, ["model", "query_id"], {"latency_ms": 1, "cost_usd": 8})
    one, all_ = jf.read_results(
        spark, folder, "model string, query_id long, precision_at_5 double, reciprocal_rank double, latency_ms double", "model string, precision_at_5 double, reciprocal_rank double, avg_latency_ms double"
    )
    a = one.select(F.lit("individual").alias("part"), "model", F.col("query_id").cast("string").alias("id"), "precision_at_5", "reciprocal_rank", F.coalesce("latency_ms", F.lit(-1.0)).alias("latency_ms"))
    return a.unionByName(all_.select(F.lit("aggregated").alias("part"), "model", F.lit("").alias("id"), "precision_at_5", "reciprocal_rank", F.col("avg_latency_ms").alias("latency_ms")))
