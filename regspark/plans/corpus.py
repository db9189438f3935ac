"""A corpus with legal structure, derived from all rows of `documents`.

The first line of a document is its preamble; every other line becomes an
article (or, every third document, a numbered section of guidance) that refers
to another one of the same number space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPARK = r"""
SELECT doc_id, concat('doc', doc_id) AS source_id, concat('Document ', doc_id) AS title,
       CASE WHEN doc_id % 3 = 0 THEN 'guidance' ELSE 'statute' END AS instrument_type,
       CASE WHEN lang IN ('de', 'fr') THEN 'CH' ELSE 'EU' END AS jurisdiction,
       array_join(transform(ls, (x, i) -> CASE WHEN i = 0 THEN x ELSE concat(
         CASE WHEN doc_id % 5 = 0 AND i % 3 = 1 THEN concat('CHAPTER ', element_at(array('I', 'II', 'III', 'IV'), i % 4 + 1), '\n') ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat(i, ' Section ') WHEN lang IN ('de', 'fr') THEN concat('Art. ', i, '\n') ELSE concat('Article ', i, '\n') END,
         x, CASE WHEN lang IN ('de', 'fr') THEN ' see Art. ' ELSE ' see Article ' END, (doc_id * 7 + i) % size(ls) + 1, '.') END), '\n') AS full_text
FROM (SELECT doc_id, lang, split(coalesce(text, ''), '\n') AS ls FROM {documents})
"""


def legal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK, documents=view(spark, sf_dir, "documents"))


#: The same in the other dialect, and what the queries derive from it, as common table expressions.
LEGAL = r"""legal AS (
SELECT doc_id, 'doc' || doc_id AS source_id, 'Document ' || doc_id AS title,
       CASE WHEN doc_id % 3 = 0 THEN 'guidance' ELSE 'statute' END AS instrument_type,
       CASE WHEN lang IN ('de', 'fr') THEN 'CH' ELSE 'EU' END AS jurisdiction,
       array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN x ELSE
         CASE WHEN doc_id % 5 = 0 AND (i - 1) % 3 = 1 THEN 'CHAPTER ' || ['I', 'II', 'III', 'IV'][(i - 1) % 4 + 1] || chr(10) ELSE '' END ||
         CASE WHEN doc_id % 3 = 0 THEN (i - 1) || ' Section ' WHEN lang IN ('de', 'fr') THEN 'Art. ' || (i - 1) || chr(10) ELSE 'Article ' || (i - 1) || chr(10) END ||
         x || CASE WHEN lang IN ('de', 'fr') THEN ' see Art. ' ELSE ' see Article ' END || ((doc_id * 7 + i - 1) % len(ls) + 1) || '.' END), chr(10)) AS full_text
FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""

SPANS = r"""parts AS (
  SELECT *, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (
    SELECT *, string_split(CASE WHEN instrument_type = 'statute' THEN regexp_replace(full_text, '(?m)^((?:Article|Art\.)\s+\d+[a-z]?)\b', chr(1) || '\1', 'g')
      ELSE regexp_replace(full_text, '(?m)^(\d+(?:\.\d+)*)(\s+[A-Z])', chr(1) || '\1\2', 'g') END, chr(1)) AS p FROM legal)),
spans AS (
  SELECT source_id, doc_id, instrument_type, jurisdiction, full_text, k - 1 AS k, part,
         CASE WHEN k > 1 THEN regexp_extract(part, CASE WHEN instrument_type = 'statute' THEN '^((?:Article|Art\.)\s+\d+[a-z]?)' ELSE '^(\d+(?:\.\d+)*)' END, 1) END AS label,
         CAST(sum(length(part)) OVER (PARTITION BY source_id ORDER BY k) - length(part) AS BIGINT) AS start, len(p) - 1 AS n_spans,
         regexp_replace(part, '^\s+|\s+$', '', 'g') AS body
  FROM parts),
headed AS (
  SELECT *, last_value(CASE WHEN k > 0 AND instrument_type = 'statute' THEN ch END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY k) AS chapter,
         len(regexp_extract_all(body, '\S+')) AS nw
  FROM (SELECT *, nullif(list_last(regexp_extract_all(substr(full_text, greatest(0, start - 500) + 1, least(start, 500)), '(?m)^(CHAPTER\s+[IVXLCDM]+)', 1)), '') AS ch FROM spans))"""

CHUNKS = r"""pieces AS (
  SELECT *, CASE WHEN n_spans = 0 THEN 2 WHEN k = 0 THEN 0 WHEN floor(nw * CAST(1.3 AS DOUBLE)) <= 512 THEN 1 ELSE 2 END AS how
  FROM headed
  WHERE n_spans = 0 OR (k = 0 AND floor(nw * CAST(1.3 AS DOUBLE)) > 20) OR (k > 0 AND body <> '')),
cut AS (
  SELECT *, body AS text, CAST(0 AS BIGINT) AS w FROM pieces WHERE how < 2
  UNION ALL BY NAME
  SELECT * EXCLUDE (ws) FROM (
    SELECT *, array_to_string(ws[w + 1:w + 393], ' ') AS text FROM (
      SELECT *, regexp_extract_all(body, '\S+') AS ws FROM pieces WHERE how = 2) AS x, LATERAL (SELECT unnest(range(0, greatest(0, nw - 50) + 1, 344)) AS w))
  WHERE nw > 0),
chunks AS (
  SELECT *, substr(sha256(source_id || ':' || coalesce(article, section, 'none') || ':' || chunk_index), 1, 16) AS chunk_id FROM (
    SELECT source_id, doc_id, instrument_type, jurisdiction, text, row_number() OVER (PARTITION BY source_id ORDER BY k, w) - 1 AS chunk_index,
           CASE WHEN instrument_type = 'statute' AND how < 2 OR instrument_type = 'statute' AND n_spans > 0 THEN label END AS article,
           CASE WHEN instrument_type = 'statute' AND n_spans > 0 AND k = 0 THEN 'Preamble' END AS paragraph,
           CASE WHEN instrument_type = 'statute' AND n_spans > 0 THEN chapter END AS chapter,
           CASE WHEN instrument_type <> 'statute' AND n_spans > 0 THEN CASE WHEN k = 0 THEN 'Preamble' ELSE label END END AS section
    FROM cut)),
refs AS (
  SELECT *, list_sort(list_filter(list_distinct(regexp_extract_all(text, '(?:Article|Art\.)\s+\d+[a-z]?(?:\s*\(\d+\))?(?:\s*(?:point|letter)\s*\([a-z]\))?')), lambda r: r IS DISTINCT FROM article)) AS cross_references
  FROM chunks)"""


#: Chunks of the article of definitions, in the two forms that such articles have: quoted terms, one to a chunk, or lettered ones.
_DEFINITION = r"""CASE WHEN article = 'Article 4' THEN concat('1. \'', element_at(w, 1), '\' means ', text, ';')
  ELSE concat('In this law:', array_join(transform(slice(w, 1, 3), (x, i) -> concat('\n', substr('abc', i + 1, 1), '. ', x, ' means ', regexp_replace(text, '\\s+', ' '), ';')), '')) END"""


def definition_chunks(chunks: DataFrame) -> DataFrame:
    d = chunks.where("article in ('Article 4', 'Art. 4')").withColumn("w", F.filter(F.regexp_extract_all("text", F.lit(r"[^\s'‘’;]+"), F.lit(0)), lambda x: F.length(x) > 4))
    return d.where("size(w) > 0").select("source_id", "article", "chunk_index", F.expr(_DEFINITION).alias("text"))


DEFINED = r"""defined AS (
  SELECT source_id || ':def:' || lower(term) AS node_id, term, substr(regexp_replace(regexp_replace(body || ';', '^\s+|\s+$', '', 'g'), ';+$', ''), 1, 500) AS definition_text, source_id, article AS article_label, chunk_index, item FROM (
    SELECT *, unnest(CASE WHEN article = 'Article 4' THEN w[1:1] ELSE w[1:3] END) AS term, unnest(CASE WHEN article = 'Article 4' THEN [1] ELSE [1, 2, 3][1:len(w)] END) AS item,
           CASE WHEN article = 'Article 4' THEN text ELSE regexp_replace(text, '\s+', ' ', 'g') END AS body
    FROM (SELECT *, list_filter(regexp_extract_all(text, '[^\s''‘’;]+'), lambda x: length(x) > 4) AS w FROM chunks WHERE article IN ('Article 4', 'Art. 4')) WHERE len(w) > 0)),
definitions AS (SELECT * FROM defined QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY chunk_index DESC, item DESC) = 1)"""

#: What a model might have said of an article: up to seven obligations as JSON, fenced or not, or a sentence.
_RESPONSE = r"""CASE WHEN length(full_text) % 11 = 0 THEN concat('No duty: ', full_text) ELSE concat(CASE WHEN length(full_text) % 2 = 0 THEN '```json\n' ELSE '' END,
  to_json(transform(sequence(1, CAST(1 + length(full_text) % 7 AS INT)), k -> named_struct('description', concat(' Duty ', k, ': ', substr(full_text, 20 * k, 180)), 'type', element_at(array('obligation', 'Right ', 'PROHIBITION', 'permission', 'duty'), k % 5 + 1), 'subject', ' controller'))),
  CASE WHEN length(full_text) % 2 = 0 THEN '\n```' ELSE '' END) END"""


def model_responses(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("node_id").alias("article_node_id"), "source_id", "article_label", F.expr(_RESPONSE).alias("response"))


IMPOSED = r"""duties AS (
  SELECT node_id AS article_node_id, source_id, article_label, k, regexp_replace('Duty ' || k || ': ' || substr(full_text, 20 * k, 180), '^\s+|\s+$', '', 'g') AS d, ['obligation', 'right', 'prohibition', 'permission', 'obligation'][k % 5 + 1] AS obligation_type
  FROM (SELECT *, unnest(range(1, CAST(2 + length(full_text) % 7 AS INT))) AS k FROM articles WHERE article_label NOT IN ('Article 4', 'Art. 5') AND length(full_text) >= 100 AND length(full_text) % 11 <> 0)),
imposed AS (SELECT substr(sha256(source_id || ':' || article_label || ':' || substr(d, 1, 50)), 1, 16) AS node_id, substr(d, 1, 300) AS description, obligation_type, 'controller' AS subject, source_id, article_node_id, k FROM duties),
obligations AS (SELECT * FROM imposed QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY k DESC) = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def statutes(docs: DataFrame) -> DataFrame:
    """Which statute a document's references mean: first its own or the next one's, else a neighbour's."""
    return docs.selectExpr(
        "source_id",
        "CASE WHEN doc_id % 3 = 0 THEN concat('doc', doc_id + 1) ELSE source_id END AS primary_statute",
        "concat('doc', CASE doc_id % 3 WHEN 0 THEN doc_id + 2 WHEN 1 THEN doc_id + 1 ELSE doc_id - 1 END) AS fallback_statute",
    )


def equivalence_pairs(docs: DataFrame) -> DataFrame:
    """Curated pairs: the first five articles of two neighbouring statutes, in either style of label."""
    left = docs.where("doc_id % 3 = 1").selectExpr("doc_id", "source_id", "explode(sequence(1, 5)) AS n")
    each = left.selectExpr("doc_id", "source_id", "n", "explode(array('Article ', 'Art. ')) AS l").selectExpr("*", "explode(array('Article ', 'Art. ')) AS r")
    return each.selectExpr("concat(source_id, ':', l, n) AS left_id", "concat('doc', doc_id + 1, ':', r, n) AS right_id", "concat('Topic ', n) AS note")


ARTICLES = r"""arts AS (
  SELECT source_id, article AS article_label, source_id || ':' || article AS node_id, string_agg(text, chr(10) ORDER BY chunk_index) AS t,
         arg_min(coalesce(chapter, ''), chunk_index) AS chapter, arg_min(coalesce(section, ''), chunk_index) AS section FROM chunks WHERE article IS NOT NULL GROUP BY source_id, article),
articles AS (SELECT node_id, source_id, article_label, chapter, section, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '...' ELSE t END AS full_text FROM arts)"""

EDGES = r"""statutes AS (
  SELECT source_id, CASE WHEN doc_id % 3 = 0 THEN 'doc' || (doc_id + 1) ELSE source_id END AS primary_statute,
         'doc' || (CASE doc_id % 3 WHEN 0 THEN doc_id + 2 WHEN 1 THEN doc_id + 1 ELSE doc_id - 1 END) AS fallback_statute FROM legal),
mentions AS (SELECT source_id, instrument_type, article, source_id || ':' || article AS src, chunk_index, unnest(cross_references) AS ref FROM refs),
numbered AS (SELECT source_id AS s, regexp_extract(article_label, '^(?:Article|Art\.)\s+(\d+[a-z]?)', 1) AS n, min(node_id) AS t FROM articles GROUP BY 1, 2),
resolved AS (
  SELECT m.*, coalesce(p.t, f.t) AS target FROM (SELECT *, regexp_extract(ref, '^(?:Article|Art\.)\s+(\d+[a-z]?)', 1) AS num FROM mentions) m JOIN statutes st USING (source_id)
  LEFT JOIN numbered p ON p.s = st.primary_statute AND p.n = num LEFT JOIN numbered f ON f.s = st.fallback_statute AND f.n = num),
refers AS (SELECT src, target AS dst, ref AS reference_text FROM resolved WHERE article IS NOT NULL AND target <> src QUALIFY row_number() OVER (PARTITION BY src, target ORDER BY chunk_index, ref) = 1),
citing AS (SELECT DISTINCT source_id AS src, target AS dst FROM resolved WHERE instrument_type = 'guidance' AND target IS NOT NULL),
pairs AS (SELECT l.source_id || ':' || a || n AS left_id, 'doc' || (l.doc_id + 1) || ':' || b || n AS right_id, 'Topic ' || n AS note
  FROM (SELECT * FROM legal WHERE doc_id % 3 = 1) l, range(1, 6) t(n), (VALUES ('Article '), ('Art. ')) x(a), (VALUES ('Article '), ('Art. ')) y(b)),
equals AS (SELECT left_id AS src, right_id AS dst, note FROM pairs WHERE left_id IN (SELECT node_id FROM articles) AND right_id IN (SELECT node_id FROM articles)),
edges AS (
  SELECT source_id || ':' || article_label AS src, node_id AS dst, 'DEFINES' AS type FROM definitions WHERE source_id || ':' || article_label IN (SELECT node_id FROM articles) UNION ALL
  SELECT DISTINCT article_node_id, node_id, 'IMPOSES' FROM imposed UNION ALL
  SELECT src, dst, 'REFERENCES' AS type FROM refers UNION ALL SELECT src, dst, 'CITES' FROM citing UNION ALL
  SELECT src, dst, 'EQUIVALENT_TO' FROM equals UNION ALL SELECT source_id, node_id, 'CONTAINS' FROM articles)"""

NODES = r"""nodes AS (
  SELECT source_id AS node_id, 'Instrument' AS kind, title AS label FROM legal UNION ALL SELECT node_id, 'Article', article_label FROM articles UNION ALL
  SELECT node_id, 'Definition', term FROM definitions UNION ALL SELECT node_id, 'Obligation', CASE WHEN length(description) > 40 THEN substr(description, 1, 40) || '...' ELSE description END FROM obligations)"""

GRAPH = (LEGAL, SPANS, CHUNKS, ARTICLES, DEFINED, IMPOSED, EDGES, NODES)
