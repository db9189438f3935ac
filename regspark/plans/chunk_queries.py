"""Queries for spans, chunks and the text functions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ch
from .common import Area
from .corpus import CHUNKS, LEGAL, SPANS, legal_docs, view, with_

query = Area()
QUERIES, ORACLES = query.queries, query.oracles


@query(with_(LEGAL, SPANS) + "SELECT source_id, CAST(k AS INT) AS position, label, CAST(start AS INT) AS start_at, md5(part) AS span_md5 FROM spans WHERE k > 0 AND instrument_type = 'statute'")
def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = legal_docs(spark, sf_dir).where("instrument_type = 'statute'")
    return ch.regex_spans(docs).select("source_id", "position", "label", F.col("start").alias("start_at"), F.md5("span").alias("span_md5"))


@query(with_(LEGAL, SPANS, CHUNKS) + "SELECT chunk_id, source_id, CAST(chunk_index AS INT) AS chunk_index, article, paragraph, chapter, section, md5(text) AS text_md5, array_to_string(cross_references, '|') AS refs FROM refs")
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ch.chunk_corpus(legal_docs(spark, sf_dir))
    return c.select("chunk_id", "source_id", "chunk_index", "article", "paragraph", "chapter", "section", F.md5("text").alias("text_md5"), F.array_join("cross_references", "|").alias("refs"))


@query(with_(LEGAL, SPANS, CHUNKS) + "SELECT source_id, CAST(chunk_index AS INT) AS chunk_index, article, paragraph, chapter FROM refs WHERE instrument_type = 'statute'")
def chunk_statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = legal_docs(spark, sf_dir).where("instrument_type = 'statute'")
    return ch.numbered_chunks(ch.statute_chunks(docs)).select("source_id", "chunk_index", "article", "paragraph", "chapter")


@query(with_(LEGAL, SPANS, CHUNKS) + "SELECT source_id, CAST(chunk_index AS INT) AS chunk_index, section, CAST(length(text) AS INT) AS n_chars FROM refs WHERE instrument_type = 'guidance'")
def chunk_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = legal_docs(spark, sf_dir).where("instrument_type = 'guidance'")
    return ch.numbered_chunks(ch.guidance_chunks(docs)).select("source_id", "chunk_index", "section", F.length("text").alias("n_chars"))


@query(with_(LEGAL, SPANS) + "SELECT source_id, label, chapter FROM headed WHERE k > 0 AND instrument_type = 'statute'")
def carry_forward_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ch.headed_spans(legal_docs(spark, sf_dir).where("instrument_type = 'statute'"))
    return d.select("source_id", F.explode_outer("_spans").alias("s")).where("s is not null").select("source_id", "s.label", "s.chapter")


@query(with_(LEGAL, SPANS, CHUNKS) + "SELECT chunk_id, source_id, CAST(chunk_index AS INT) AS chunk_index FROM refs")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_corpus(legal_docs(spark, sf_dir)).select("chunk_id", "source_id", "chunk_index")


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - 50) + 1, 344)) AS i FROM w WHERE len(ws) > 0)
    SELECT doc_id, CAST(i // 344 AS INT) AS window_index, CAST(len(ws[i + 1:i + 393]) AS INT) AS n_words, md5(array_to_string(ws[i + 1:i + 393], ' ')) AS text_md5 FROM s"""
)
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(ch.windows(F.col("text"))).alias("window_index", "w")).where("w is not null")
    return d.select("doc_id", "window_index", F.size(tx.words(F.col("w"))).alias("n_words"), F.md5("w").alias("text_md5"))


_RECITALS = r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 2 = 0 THEN '(' || i || ') ' || x ELSE x END), chr(10)) AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(t, '(?m)^(\(\d+\)\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM t),
r AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k, len(p) AS n, t FROM p)
SELECT doc_id, CAST(CASE WHEN n = 1 THEN 0 ELSE k - 2 END AS INT) AS chunk_index, CASE WHEN n = 1 THEN 'Preamble' ELSE 'Recital ' || regexp_extract(part, '^\((\d+)\)', 1) END AS paragraph,
       md5(CASE WHEN n = 1 THEN t ELSE regexp_replace(part, '^\s+|\s+$', '', 'g') END) AS text_md5
FROM r WHERE n = 1 OR k > 1"""


@query(_RECITALS)
def chunk_recitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "array_join(transform(split(coalesce(text, ''), '\\n'), (x, i) -> CASE WHEN i % 2 = 1 THEN concat('(', i + 1, ') ', x) ELSE x END), '\\n')"
    d = view(spark, sf_dir, "documents").select("doc_id", F.expr(marked).alias("t"))
    d = d.select("doc_id", F.posexplode_outer(ch.recital_chunks(F.col("t"))).alias("chunk_index", "c")).where("c is not null")
    return d.select("doc_id", "chunk_index", "c.paragraph", F.md5("c.text").alias("text_md5"))


_PARAGRAPHS = r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: i || '. ' || x), chr(10)) AS t FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)^(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM t),
r AS (SELECT doc_id, regexp_replace(part, '^\s+|\s+$', '', 'g') AS body, k, regexp_extract(part, '^(\d+)', 1) AS n FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM p) WHERE k > 1),
s AS (SELECT *, regexp_extract_all(body, '\S+') AS ws FROM r),
c AS (SELECT doc_id, k, n, body AS text, 0 AS w FROM s WHERE floor(len(ws) * CAST(1.3 AS DOUBLE)) <= 512
  UNION ALL SELECT doc_id, k, n, array_to_string(ws[w + 1:w + 393], ' '), w FROM (SELECT *, unnest(range(0, greatest(0, len(ws) - 50) + 1, 344)) AS w FROM s WHERE floor(len(ws) * CAST(1.3 AS DOUBLE)) > 512))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, w) - 1 AS INT) AS chunk_index, n AS paragraph, md5(text) AS text_md5 FROM c"""


@query(_PARAGRAPHS)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").select("doc_id", F.expr("array_join(transform(split(coalesce(text, ''), '\\n'), (x, i) -> concat(i + 1, '. ', x)), '\\n')").alias("t"))
    null = F.lit(None).cast("string")
    d = d.select("doc_id", F.posexplode_outer(ch.paragraph_chunks(F.col("t"), F.lit("Article 1"), null, null)).alias("chunk_index", "c")).where("c is not null")
    return d.select("doc_id", "chunk_index", "c.paragraph", F.md5("c.text").alias("text_md5"))


_TOC = r"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: substr(l, 1, 12)), lambda t: length(t) = 12) AS toc FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, title, instr(text, title) AS pos, ord FROM (SELECT doc_id, text, unnest(toc) AS title, generate_subscripts(toc, 1) AS ord FROM d)),
n AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, ord) AS next_pos FROM b),
s AS (SELECT doc_id, title, pos, ord, regexp_replace(substr(text, pos, coalesce(next_pos, length(text) + 1) - pos), '^\s+|\s+$', '', 'g') AS body FROM n),
c AS (SELECT *, regexp_extract_all(body, '\S+') AS ws FROM s),
l AS (SELECT *, floor(len(ws) * CAST(1.3 AS DOUBLE)) AS tokens FROM c)
SELECT doc_id, title, md5(body) AS text_md5 FROM l WHERE tokens BETWEEN 20 AND 512
UNION ALL SELECT doc_id, title, md5(array_to_string(ws[w + 1:w + 393], ' ')) FROM (SELECT *, unnest(range(0, greatest(0, len(ws) - 50) + 1, 344)) AS w FROM l WHERE tokens > 512)"""


@query(_TOC)
def chunk_by_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = F.filter(F.transform(F.split("text", "\n"), lambda x: F.substring(x, 1, 12)), lambda t: F.length(t) == 12)
    d = view(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", toc.alias("toc")).where("size(toc) > 0")
    d = d.select("doc_id", F.explode_outer(ch.toc_chunks(F.col("text"), F.col("toc"))).alias("c")).where("c.section is not null")
    return d.select("doc_id", F.col("c.section").alias("title"), F.md5("c.text").alias("text_md5"))
