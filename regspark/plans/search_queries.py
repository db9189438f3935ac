"""Queries for vector search and its evaluation over `embeddings`.

The stated query set are the rows with vec_id divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import evaluate as ev
from ..operators import search as se
from .common import Area
from .corpus import view

query = Area()
QUERIES, ORACLES = query.queries, query.oracles

_PAIRS = """q AS (SELECT vec_id AS query_id, embedding AS qv, label AS query_label FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT query_id, query_label, vec_id AS chunk_id, label, coalesce(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0) AS similarity FROM q, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM pairs)"""
_WITH = "WITH " + _PAIRS + "\n"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = view(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_label"))
    return q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


@query(_WITH + "SELECT query_id, chunk_id, round(similarity, 4) AS similarity, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(*_sets(spark, sf_dir)).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings WHERE label IN (1, 3, 5))
    SELECT query_id, chunk_id, round(s, 4) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM p) WHERE r <= 10"""
)
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _sets(spark, sf_dir)
    return se.top_k(q, c.where(se.any_of("label", [1, 3, 5]))).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"), "rank")


@query()
def vector_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _sets(spark, sf_dir)
    return se.top_k_lsh(q.select("query_id", "query_vec"), c.select("chunk_id", "vec")).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"), "rank")


@query(_WITH + "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM ranked")
def rank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rankings(*_sets(spark, sf_dir))


@query(_WITH + "SELECT query_id, chunk_id, round(similarity, 4) AS similarity FROM pairs")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.similarities(*_sets(spark, sf_dir)).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS h FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM v)
    SELECT vec_id, len(h) AS dims, round(h[1] / n, 4) AS x0, round(h[16] / n, 4) AS x15 FROM n"""
)
def truncate_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "embeddings").select("vec_id", vx.shortened(F.col("embedding"), 16).alias("h"))
    return d.select("vec_id", F.size("h").cast("long").alias("dims"), F.round(F.get("h", F.lit(0)), 4).alias("x0"), F.round(F.get("h", F.lit(15)), 4).alias("x15"))


@query(
    """SELECT count(d.doc_id) AS chunks, count(e.vec_id) AS vectors, count(*) FILTER (d.doc_id IS NULL) AS vectors_alone, count(*) FILTER (e.vec_id IS NULL) AS chunks_alone, count(*) FILTER (len(e.embedding) <> 64) AS wrong_size
    FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id"""
)
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = view(spark, sf_dir, "documents").select("doc_id"), view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = d.join(e, F.col("doc_id") == F.col("vec_id"), "full")
    return both.agg(
        F.count("doc_id").alias("chunks"), F.count("vec_id").alias("vectors"), F.count_if(F.col("doc_id").isNull()).alias("vectors_alone"), F.count_if(F.col("vec_id").isNull()).alias("chunks_alone"),
        F.count_if(F.size("embedding") != 64).alias("wrong_size"),
    )


_SCORES = """scores AS (SELECT query_id, query_label, round(count(*) FILTER (hit AND rank <= 5) / 5.0, 4) AS precision_at_5, round(count(*) FILTER (hit AND rank <= 10) / 10.0, 4) AS precision_at_10,
  round(coalesce(1.0 / min(rank) FILTER (hit), 0), 4) AS reciprocal_rank FROM (SELECT query_id, query_label, label = query_label AS hit, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM pairs WHERE chunk_id <> query_id) GROUP BY 1, 2)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.retrieval_scores(se.first_relevant(*_sets(spark, sf_dir)), ["query_id", "query_label"])


@query(_WITH[:-1] + ",\n" + _SCORES + "SELECT query_id, CAST(precision_at_5 AS DOUBLE) AS precision_at_5, CAST(precision_at_10 AS DOUBLE) AS precision_at_10 FROM scores")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query_id", "precision_at_5", "precision_at_10")


@query(_WITH[:-1] + ",\n" + _SCORES + "SELECT query_id, CAST(reciprocal_rank AS DOUBLE) AS reciprocal_rank FROM scores")
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query_id", "reciprocal_rank")


_MODEL = "CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END"
_MEANS = "round(avg(precision_at_5), 4) AS precision_at_5, round(avg(precision_at_10), 4) AS precision_at_10, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(coalesce(avg(latency_ms), 0), 1) AS avg_latency_ms, round(coalesce(avg(cost_usd), 0), 8) AS avg_cost_usd"
#: US dollars for a million tokens.
_PRICES = (("even", 0.13, 0.0), ("odd", 0.02, 0.0))
_PAID = f"""paid AS (SELECT s.*, {_MODEL} AS model, query_label AS category, round(value, 1) AS latency_ms, (user_id % 500 + 1) * CASE WHEN query_id % 100 = 0 THEN 0.13 ELSE 0.02 END / 1e6 AS cost_usd FROM scores s LEFT JOIN events ON event_id = query_id)"""


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each query with what an event of its number took, and what its tokens cost."""
    spent = view(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.round("value", 1).alias("latency_ms"), (F.col("user_id") % 500 + 1).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    s = _scores(spark, sf_dir).join(spent, "query_id", "left").withColumn("model", F.expr(_MODEL)).withColumn("category", F.col("query_label"))
    return ev.costs(s, spark.createDataFrame(_PRICES, "model string, per_million_input double, per_million_output double"))


_PAID_SCORES = _WITH[:-1] + ",\n" + _SCORES + ",\n" + _PAID


@query(_PAID_SCORES + f" SELECT model, {_MEANS} FROM paid GROUP BY 1")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.retrieval_summary(_paid(spark, sf_dir))


@query(_PAID_SCORES + f" SELECT model, category, {_MEANS} FROM paid GROUP BY GROUPING SETS ((model), (model, category))")
def retrieval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.retrieval_summary(_paid(spark, sf_dir), by_category=True)


@query(_PAID_SCORES + " SELECT query_id, model, CAST(precision_at_5 AS DOUBLE) AS precision_at_5, CAST(precision_at_10 AS DOUBLE) AS precision_at_10, CAST(reciprocal_rank AS DOUBLE) AS reciprocal_rank, latency_ms, round(cost_usd, 10) AS cost_usd FROM paid")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir).select("query_id", "model", "precision_at_5", "precision_at_10", "reciprocal_rank", "latency_ms", F.round("cost_usd", 10).alias("cost_usd"))


@query("SELECT event_type, count(*) AS n, round(sum(value * 0.15 / 1e6 + (event_id % 500) * 1.5 / 1e6), 6) AS cost_usd FROM events GROUP BY event_type")
def query_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("value") * 0.15 / 1e6 + (F.col("event_id") % 500) * 1.5 / 1e6
    return view(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 6).alias("cost_usd"))


@query(
    """WITH m AS (SELECT event_type AS model, label AS query_label FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT label FROM embeddings)),
    o AS (SELECT event_type AS model, CAST(user_id % 20 AS INT) AS query_label, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT m.model, m.query_label, coalesce(o.n, 0) AS runs FROM m LEFT JOIN o USING (model, query_label)"""
)
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events")
    grid = e.select(F.col("event_type").alias("model")).distinct().crossJoin(view(spark, sf_dir, "embeddings").select(F.col("label").alias("query_label")).distinct())
    seen = e.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 20).cast("int").alias("query_label")).agg(F.count(F.lit(1)).alias("runs"))
    return grid.join(seen, ["model", "query_label"], "left").select("model", "query_label", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


@query(
    """WITH s AS (SELECT user_id, event_type, round(sum(value), 2) AS ms, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS stages, CAST(sum(n) AS BIGINT) AS items, round(sum(ms), 2) AS total_ms FROM s GROUP BY user_id"""
)
def query_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = view(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("ms"), F.count(F.lit(1)).alias("n"))
    return stages.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("stages"), F.sum("n").alias("items"), F.round(F.sum("ms"), 2).alias("total_ms"))
