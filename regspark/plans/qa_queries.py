"""Queries for questions, prompts, answers, transcripts and extraction scores.

Questions are the user turns of `conversations`, answers the assistant turns
that follow; both get article names from their ids, as the corpus has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import FILLERS
from ..operators import context as cx
from ..operators import evaluate as ev
from ..operators import interpret as it
from ..operators import search as se
from ..sources.tables import assembled, stored
from .common import Area
from .corpus import CHUNKS, GRAPH, LEGAL, SPANS, legal_docs, view, with_
from .graph_queries import Graph

query = Area()
QUERIES, ORACLES = query.queries, query.oracles

_QUESTION = """concat(text, CASE conv_id % 6 WHEN 0 THEN concat(' GDPR Article ', turn + 1) WHEN 1 THEN concat(' Art. ', conv_id % 40, ' of the FADP and GDPR art ', conv_id % 7)
  WHEN 2 THEN concat(' Article ', conv_id % 9, ' gdpr') WHEN 3 THEN ' in Switzerland, says the EDPB' WHEN 4 THEN ' says the FDPIC' ELSE '' END)"""
_ASKED = f"SELECT conv_id, turn, {_QUESTION} AS q FROM conversations WHERE role = 'user'"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{_QUESTION} AS q")


@query(
    f"""WITH a AS ({_ASKED}), p AS (
      SELECT conv_id, turn, list_concat(list_concat(
        list_transform(list_zip(regexp_extract_all(q, '(?i)\\b(GDPR|FADP)\\s+(?:Article|Art\\.?)\\s*(\\d+)', 1), regexp_extract_all(q, '(?i)\\b(GDPR|FADP)\\s+(?:Article|Art\\.?)\\s*(\\d+)', 2)), lambda x: [x[1], x[2]]),
        list_transform(list_zip(regexp_extract_all(q, '(?i)\\b(?:Article|Art\\.?)\\s*(\\d+)\\s+(?:of\\s+(?:the\\s+)?)?(GDPR|FADP)', 2), regexp_extract_all(q, '(?i)\\b(?:Article|Art\\.?)\\s*(\\d+)\\s+(?:of\\s+(?:the\\s+)?)?(GDPR|FADP)', 1)), lambda x: [x[1], x[2]])),
        list_transform(list_zip(regexp_extract_all(q, '(?i)\\b(?:Article|Art\\.?)\\s*(\\d+)\\s+(GDPR|FADP)\\b', 2), regexp_extract_all(q, '(?i)\\b(?:Article|Art\\.?)\\s*(\\d+)\\s+(GDPR|FADP)\\b', 1)), lambda x: [x[1], x[2]])) AS r FROM a),
    u AS (SELECT conv_id, turn, ref, min(k) AS k FROM (SELECT conv_id, turn, unnest(list_transform(r, lambda x: CASE WHEN lower(x[1]) = 'gdpr' THEN 'gdpr:Article ' ELSE 'fadp:Art. ' END || x[2])) AS ref, generate_subscripts(r, 1) AS k FROM p) GROUP BY 1, 2, 3)
    SELECT p.conv_id, p.turn, coalesce(string_agg(ref, '|' ORDER BY k), '') AS refs FROM p LEFT JOIN u USING (conv_id, turn) GROUP BY 1, 2"""
)
def interpret_article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.array_join(it.article_refs(F.col("q")), "|").alias("refs"))


def _keyword_sql(keywords: tuple[tuple[str, str], ...]) -> str:
    firsts: dict[str, str] = {}
    for k, v in keywords:
        firsts[v] = f"{firsts[v]} OR contains(lower(q), '{k}')" if v in firsts else f"contains(lower(q), '{k}')"
    place = {v: "least(" + ", ".join(f"CASE WHEN contains(lower(q), '{k}') THEN {i} ELSE 99 END" for i, (k, w) in enumerate(keywords) if w == v) + ")" for v in firsts}
    rows = ", ".join(f"{{'p': {place[v]}, 'v': '{v}'}}" for v in firsts)
    return f"array_to_string(list_transform(list_filter(list_sort([{rows}]), lambda x: x.p < 99), lambda x: x.v), '|')"


@query(f"WITH a AS ({_ASKED}) SELECT conv_id, turn, {_keyword_sql(it.JURISDICTIONS)} AS jurisdictions, {_keyword_sql(it.SOURCES)} AS sources FROM a")
def interpret_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, s = it.keyword_filters(F.col("q"), it.JURISDICTIONS), it.keyword_filters(F.col("q"), it.SOURCES)
    return _asked(spark, sf_dir).select("conv_id", "turn", F.array_join(j, "|").alias("jurisdictions"), F.array_join(s, "|").alias("sources"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND turn % 3 <> 0 THEN 'audio' ELSE 'text' END AS route FROM conversations")
def route_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode, path = F.when(F.col("conv_id") % 2 == 0, "audio"), F.when(F.col("turn") % 3 != 0, "a.wav").otherwise("")
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", it.input_route(mode, path).alias("route"))


@query(with_(LEGAL) + "SELECT source_id FROM legal WHERE jurisdiction IN ('CH') AND instrument_type IN ('statute', 'guidance')")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.metadata_filter(legal_docs(spark, sf_dir), None, ["CH"], ["statute", "guidance"]).select("source_id")


#: Hits: the i-th chunk of a document is its hit of rank i + 1, at a distance by rank.
_HIT_ROWS = ("hits AS (SELECT source_id AS query_id, CAST(chunk_index + 1 AS INT) AS rank, source_id, article, section, paragraph, instrument_type, text, CASE WHEN chunk_index % 7 <> 6 THEN (chunk_index + 1) / 64.0 END AS distance FROM chunks)")
_HITS = with_(LEGAL, SPANS, CHUNKS, _HIT_ROWS)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Graph(spark, sf_dir).chunks
    return c.select(F.col("source_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "source_id", "article", "section", "paragraph", "instrument_type", "text", F.when(F.col("chunk_index") % 7 != 6, (F.col("chunk_index") + 1) / 64.0).alias("distance"))


@query(_HITS + "SELECT query_id, rank, article, section, paragraph, round(CAST(coalesce(distance, 1) AS DOUBLE), 4) AS distance, round(1 - CAST(coalesce(distance, 1) AS DOUBLE), 4) AS score FROM hits")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.hit_rows(_hits(spark, sf_dir)).select("query_id", "rank", "article", "section", "paragraph", "distance", "score")


@query(_HITS + "SELECT query_id, rank, CASE instrument_type WHEN 'statute' THEN 'Statute' WHEN 'guidance' THEN 'Regulator Guidance' WHEN 'commentary' THEN 'Commentary' ELSE instrument_type END AS authority, coalesce(nullif(concat_ws(' > ', nullif(article, ''), nullif(section, ''), nullif(paragraph, '')), ''), '(no location)') AS location FROM hits")
def hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", tx.named(F.col("instrument_type"), tx.AUTHORITIES).alias("authority"), tx.location(F.col("article"), F.col("section"), F.col("paragraph")).alias("location"))


@query(
    _HITS + r"""SELECT query_id, rank, upper(source_id) AS source, coalesce(nullif(concat_ws(' > ', article, section), ''), '(no location)') AS location, format('{:.3f}', 1 - CAST(coalesce(distance, 1) AS DOUBLE)) AS score,
    replace(substr(text, 1, 300), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview FROM hits"""
)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.evidence(se.hit_rows(_hits(spark, sf_dir)))


@query(_HITS + "SELECT query_id, source_id || ':' || article AS ref, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source_id || ':' || article) AS INT) AS place FROM hits WHERE article IS NOT NULL GROUP BY query_id, source_id, article QUALIFY place <= 5")
def expand_seed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.seeds_of_hits(_hits(spark, sf_dir)).select("query_id", "ref", "place")


#: Prompts as SURVEY has them: for each document as a query, its ten first chunks, and what the graph has on the first five articles among these.
_ITEMS = r"""first AS (SELECT * FROM hits WHERE rank <= 10),
seeds AS (SELECT query_id, source_id || ':' || article AS ref, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source_id || ':' || article) AS place FROM first WHERE article IS NOT NULL GROUP BY query_id, source_id, article QUALIFY place <= 5)"""
_SECTIONS = r"""duty AS (SELECT e.src AS ref, e.dst, o.obligation_type, o.description, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS r, count(*) OVER (PARTITION BY e.src) AS n FROM edges e JOIN obligations o ON o.node_id = e.dst WHERE e.type = 'IMPOSES'),
ends AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY way, other) AS r FROM (SELECT src AS ref, 0 AS way, dst AS other, dst AS target FROM edges WHERE type = 'REFERENCES' UNION ALL SELECT dst, 1, src, dst FROM edges WHERE type = 'REFERENCES')),
lines AS (
  SELECT e.src AS ref, 1 AS part, e.dst AS k, ' Definition: \'' || d.term || '\' — ' || substr(d.definition_text, 1, 200) AS line FROM edges e JOIN definitions d ON d.node_id = e.dst WHERE e.type = 'DEFINES' UNION ALL
  SELECT ref, 2, '', ' Obligations (' || n || '):' FROM duty WHERE r = 1 UNION ALL SELECT ref, 3, dst, '    [' || obligation_type || '] ' || substr(description, 1, 150) FROM duty WHERE r <= 5 UNION ALL
  SELECT ref, 4, '', ' Cross-references: ' || string_agg(target, ', ' ORDER BY way, other) FROM ends WHERE r <= 10 GROUP BY ref),
section_of AS (SELECT node_id AS ref, concat_ws(chr(10), chr(10) || '[Article: ' || node_id || ']', string_agg(line, chr(10) ORDER BY part, k)) AS text FROM articles LEFT JOIN lines ON ref = node_id GROUP BY node_id),
items AS (
  SELECT query_id, place, 0 AS kind, '' AS other, text FROM seeds JOIN section_of USING (ref) UNION ALL
  SELECT query_id, place, 1, e.dst, chr(10) || '[Cross-jurisdictional equivalent: ' || ref || ' ↔ ' || e.dst || ']' FROM seeds JOIN (SELECT src, dst FROM equals UNION SELECT dst, src FROM equals) e ON e.src = ref UNION ALL
  SELECT query_id, place, 2, '', chr(10) || '[Guidance citing ' || ref || ']: ' || string_agg(title, ', ' ORDER BY c.src) FROM seeds JOIN citing c ON c.dst = ref JOIN legal l ON l.source_id = c.src GROUP BY query_id, place, ref),
graph_text AS (SELECT query_id, count(*) AS n_items, chr(10) || ' Knowledge Graph Context ' || chr(10) || string_agg(text, chr(10) ORDER BY place, kind, other) AS g FROM items GROUP BY query_id),
passages AS (SELECT query_id, count(*) AS n_passages, ' Retrieved Passages ' || chr(10) || string_agg('[Passage ' || rank || '] Source: ' || upper(source_id) || ' | Location: ' || concat_ws(' > ', article, section) || ' | Type: ' || instrument_type || chr(10) || text, chr(10) ORDER BY rank) AS p FROM first GROUP BY query_id)"""
_PROMPTS = """prompts AS (SELECT source_id AS query_id, concat_ws(chr(10), p, g) AS prompt, coalesce(n_passages, 0) AS n_passages, coalesce(n_items, 0) AS n_items FROM legal l LEFT JOIN passages ON passages.query_id = source_id LEFT JOIN graph_text ON graph_text.query_id = source_id)"""
_SECTIONS = _SECTIONS.replace("\\'", "''")
_GRAPH_HITS = with_(*GRAPH, _HIT_ROWS, _ITEMS, _SECTIONS, _PROMPTS)


def _prompt_parts(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame, DataFrame]:
    graph = Graph(spark, sf_dir)
    h = _hits(spark, sf_dir).where("rank <= 10")
    return graph, h, cx.graph_items(it.seeds_of_hits(h), graph.edges, graph.nodes)


@query(_GRAPH_HITS + "SELECT query_id, md5(prompt) AS prompt_md5, n_passages, n_items FROM prompts")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, h, items = _prompt_parts(spark, sf_dir)
    d = cx.context_prompt(graph.docs.select(F.col("source_id").alias("query_id")), h, items)
    return d.select("query_id", F.md5("prompt").alias("prompt_md5"), "n_passages", "n_items")


@query(_GRAPH_HITS + "SELECT query_id, CAST(place AS INT) AS place, CAST(kind AS INT) AS kind, other, md5(text) AS text_md5 FROM items")
def graph_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompt_parts(spark, sf_dir)[2].select("query_id", "place", "kind", "other", F.md5("text").alias("text_md5"))


@query(
    _GRAPH_HITS + """, counted AS (
    SELECT a.node_id AS ref, (SELECT count(*) FROM edges e WHERE e.src = a.node_id AND e.type = 'DEFINES') AS n_definitions, coalesce(max(d.n), 0) AS n_obligations,
    coalesce(string_agg(d.dst || '|' || substr(d.description, 1, 120), chr(10) ORDER BY d.dst) FILTER (d.r <= 5), '') AS shown FROM articles a LEFT JOIN duty d ON d.ref = a.node_id GROUP BY a.node_id)
    SELECT ref, n_definitions, n_obligations, md5(shown) AS shown_md5, (SELECT count(*) FROM ends WHERE ends.ref = counted.ref) AS n_references,
    coalesce((SELECT string_agg(target, ', ' ORDER BY way, other) FROM ends WHERE ends.ref = counted.ref AND r <= 8), '') AS refs FROM counted"""
)
def article_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, most = Graph(spark, sf_dir), cx.IN_EVIDENCE
    d = cx.article_parts(graph.articles.select(F.col("node_id").alias("ref")), graph.edges, graph.nodes, most)
    shown = F.array_join(F.transform(F.slice("obligations", 1, most["obligations"]), lambda x: F.concat(x["other"], F.lit("|"), F.substring(x["description"], 1, most["obligation"]))), "\n")
    return d.select(
        "ref", F.coalesce(F.size("definitions").cast("long"), F.lit(0)).alias("n_definitions"), "n_obligations", F.md5(F.coalesce(shown, F.lit(""))).alias("shown_md5"), "n_references",
        F.coalesce(F.array_join(F.slice("references", 1, most["references"]), ", "), F.lit("")).alias("refs"),
    )


@query(
    _HITS + r"""SELECT query_id, md5('Context passages:' || chr(10) || chr(10) || string_agg('[' || rank || '] Source: ' || upper(source_id) || ', ' || coalesce(nullif(concat_ws(', ', article, section, paragraph), ''), 'General') || chr(10) || '"' ||
    CASE WHEN length(t) > 800 THEN substr(t, 1, 800) || '...' ELSE t END || '"', chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || query_id) AS prompt_md5
    FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM hits WHERE rank <= 5) GROUP BY query_id"""
)
def benchmark_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir).where("rank <= 5")
    line = cx.benchmark_passage(F.col("source_id"), [F.col("article"), F.col("section"), F.col("paragraph")], F.col("rank"), F.col("text"))
    d = cx.ordered_lines(h, "query_id", ["rank"], line, "\n\n", "context")
    return d.select("query_id", F.md5(cx.benchmark_prompt(F.col("context"), F.col("query_id"))).alias("prompt_md5"))


#: Rules: query, order, level, source or none, field (one of them a list, one that no chunk has), pattern.
_RULES = (
    ("q1", 1, 2, None, "article", "Article [1-3]$"), ("q1", 2, 1, None, "article", "Article"), ("q2", 1, 1, None, "article", "Art[.] .*7"), ("q3", 1, 2, "doc4", "text", "[a-z]+"), ("q3", 2, 1, None, "cross_references", "(Article|Art[.]) 2( |$)"),
    ("q4", 1, 1, None, "section", "^1$"), ("q4", 2, 2, "doc1", "no_such_field", "^$"), ("q5", 1, 2, None, "instrument_type", "guidance"), ("q5", 2, 1, None, "text", "the|die|le"),
)
_RULE = "query_id string, rule_order int, level int, rule_source string, match_field string, pattern string"
_LABELS = with_(LEGAL, SPANS, CHUNKS) + ", rules(query_id, rule_order, level, rule_source, match_field, pattern) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _RULES) + """),
values_of AS (SELECT source_id, chunk_index, unnest(['article', 'text', 'cross_references', 'section', 'instrument_type', 'no_such_field']) AS match_field,
  unnest([coalesce(article, ''), text, array_to_string(cross_references, ' '), coalesce(section, ''), instrument_type, '']) AS value FROM refs),
labels AS (SELECT query_id, v.source_id, chunk_index, CAST(arg_min(level, rule_order) AS INT) AS level FROM values_of v JOIN rules r ON r.match_field = v.match_field AND (rule_source IS NULL OR rule_source = v.source_id) AND regexp_matches(value, pattern) GROUP BY ALL)
"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Graph(spark, sf_dir).chunks.withColumn("chunk_id", F.concat_ws("#", "source_id", "chunk_index"))
    return ev.relevance_levels(spark.createDataFrame(_RULES, _RULE), c, ["article", "text", "cross_references", "section", "instrument_type"])


@query(_LABELS + "SELECT query_id, count(*) FILTER (level = 2) AS strong, count(*) FILTER (level = 1) AS weak FROM labels GROUP BY query_id")
def relevance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("query_id").agg(F.count_if(F.col("level") == 2).alias("strong"), F.count_if(F.col("level") == 1).alias("weak"))


_ANSWERS = """answers AS (SELECT conv_id, turn, text || ' Article ' || (conv_id % 5 + 1) || ' and Art. ' || (turn + 1) || CASE WHEN conv_id % 4 = 0 THEN ' cannot determine' ELSE '' END AS response_text,
  CASE WHEN conv_id % 3 = 0 THEN [] ELSE ['Article ' || (conv_id % 5 + 1), 'Article 9'] END AS expected, conv_id % 7 <> 0 AS evidence_sufficient, 'm' || (turn % 3) AS model,
  length(text) * 2 AS input_tokens, len(string_split(text, ' ')) AS output_tokens, value AS latency_ms FROM conversations LEFT JOIN (SELECT event_id, value FROM events) ON event_id = conv_id * 8 + turn WHERE role = 'assistant'),
prices(model, per_million_input, per_million_output) AS (VALUES ('m0', 0.88, 0.88), ('m1', 0.15, 1.5), ('m2', 0.6, 0.6)),
found AS (SELECT *, list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(response_text, '(?i)Article\\s+(\\d+)', 1), regexp_extract_all(response_text, '(?i)Art\\.\\s*(\\d+)', 1)), regexp_extract_all(response_text, '(?i)Recital\\s+(\\d+)', 1)), lambda n: 'Article ' || n))) AS found,
  """ + " OR ".join(f"contains(lower(response_text), '{p}')" for p in tx.UNCERTAINTY) + """ AS expressed_uncertainty FROM answers),
scored AS (SELECT *, round(CASE WHEN len(found) > 0 AND len(expected) > 0 THEN len(list_intersect(found, expected)) / CAST(len(found) AS DOUBLE) WHEN len(found) = 0 AND len(expected) = 0 THEN 1.0 ELSE 0.0 END, 3) AS citation_precision,
  round(CASE WHEN len(expected) > 0 THEN len(list_filter(expected, lambda e: list_contains(found, e))) / CAST(len(expected) AS DOUBLE) ELSE 1.0 END, 3) AS citation_recall, expressed_uncertainty <> evidence_sufficient AS calibration_correct FROM found)"""


#: US dollars for a million tokens read and written.
_PRICES = (("m0", 0.88, 0.88), ("m1", 0.15, 1.5), ("m2", 0.6, 0.6))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "concat(text, ' Article ', conv_id % 5 + 1, ' and Art. ', turn + 1, CASE WHEN conv_id % 4 = 0 THEN ' cannot determine' ELSE '' END) AS response_text",
        "CASE WHEN conv_id % 3 = 0 THEN cast(array() as array<string>) ELSE array(concat('Article ', conv_id % 5 + 1), 'Article 9') END AS expected", "conv_id % 7 <> 0 AS evidence_sufficient", "concat('m', turn % 3) AS model", "length(text) * 2 AS input_tokens", "size(split(text, ' ')) AS output_tokens",
    )
    spent = view(spark, sf_dir, "events").select(F.col("event_id"), F.col("value").alias("latency_ms"))
    timed = a.join(spent, F.col("event_id") == F.col("conv_id") * 8 + F.col("turn"), "left").drop("event_id")
    return ev.costs(ev.answer_scores(timed), spark.createDataFrame(_PRICES, "model string, per_million_input double, per_million_output double"))


@query("WITH " + _ANSWERS + " SELECT conv_id, turn, citation_precision, citation_recall, expressed_uncertainty, calibration_correct FROM scored")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", "citation_precision", "citation_recall", "expressed_uncertainty", "calibration_correct")


@query(
    "WITH " + _ANSWERS + """ SELECT model, round(coalesce(avg(citation_precision) FILTER (evidence_sufficient), 0), 3) AS citation_precision, round(coalesce(avg(citation_recall) FILTER (evidence_sufficient), 0), 3) AS citation_recall,
    round(coalesce(avg(CAST(calibration_correct AS INT)), 0), 3) AS calibration, round(coalesce(avg(CAST(expressed_uncertainty AS INT)) FILTER (NOT evidence_sufficient), 0), 3) AS insufficient_rate,
    round(coalesce(avg(CAST(expressed_uncertainty AS INT)) FILTER (evidence_sufficient), 0), 3) AS false_refusal_rate,
    round(coalesce(avg(latency_ms), 0), 1) AS avg_latency_ms, round(avg((input_tokens * per_million_input + output_tokens * per_million_output) / 1e6), 6) AS avg_cost_usd FROM scored JOIN prices USING (model) GROUP BY model"""
)
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.answer_summary(_answers(spark, sf_dir))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark item as spoken, and heard with every fifth word lost and one word too many."""
    heard = "concat_ws(' ', filter(transform(split(text, ' '), (w, i) -> CASE WHEN (i + item_id) % 5 <> 0 THEN w END), w -> w is not null), 'indeed')"
    b = view(spark, sf_dir, "benchmark").selectExpr("item_id", "text AS ground_truth", f"{heard} AS transcription", "array(split_part(text, ' ', 2), concat_ws(' ', split_part(text, ' ', 3), split_part(text, ' ', 4)), 'absent words') AS entities")
    return ev.transcript_scores(b)


_SPOKEN = r"""t AS (SELECT item_id, text AS a, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1 + item_id) % 5 <> 0 THEN w END), lambda w: w IS NOT NULL), ' ') || ' indeed' AS b,
  [split_part(text, ' ', 2), split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4), 'absent words'] AS es FROM benchmark)"""
_WORDS = _SPOKEN + r""",
w AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(a), '[^\p{L}\p{M}\p{Nd}_\s-]', '', 'g'), '\S+') AS a, regexp_extract_all(regexp_replace(lower(b), '[^\p{L}\p{M}\p{Nd}_\s-]', '', 'g'), '\S+') AS b FROM t)"""
#: All words, and those of the entities: what was said of them and what was heard.
_BOTH = _WORDS + r""",
e AS (SELECT item_id, flatten(list_transform(list_filter(es, lambda e: contains(lower(a), lower(e))), lambda e: regexp_extract_all(lower(e), '\S+'))) AS a,
  flatten(list_transform(es, lambda e: CASE WHEN contains(lower(b), lower(e)) THEN regexp_extract_all(lower(e), '\S+') ELSE list_filter(regexp_extract_all(lower(e), '\S+'), lambda x: contains(lower(b), x)) END)) AS b FROM t),
both_kinds AS (SELECT 'all' AS kind, * FROM w UNION ALL SELECT 'entities', * FROM e),
dp AS (
  SELECT kind, item_id, a, b, 0 AS i, CAST(range(0, len(b) + 1) AS BIGINT[]) AS r FROM both_kinds UNION ALL
  SELECT kind, item_id, a, b, i + 1, list_reduce(list_prepend([CAST(i + 1 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN b[j] = a[i + 1] THEN 0 ELSE 1 END)])), lambda x, y: list_append(x, least(y[1], x[len(x)] + 1))) FROM dp WHERE i < len(a)),
rates AS (SELECT kind, item_id, CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 OR kind = 'entities' THEN 0.0 ELSE 1.0 END WHEN kind = 'entities' AND len(b) = 0 THEN 1.0 ELSE r[len(b) + 1] / CAST(len(a) AS DOUBLE) END AS rate FROM dp WHERE i = len(a)),
heard AS (SELECT x.item_id, x.rate AS wer, y.rate AS entity_wer, CAST(len(list_filter(w.b, lambda v: NOT list_contains(w.a, v) AND NOT list_contains([""" + ", ".join(f"'{x}'" for x in FILLERS) + """], v))) AS INT) AS fabricated
  FROM rates x JOIN rates y ON y.item_id = x.item_id AND y.kind = 'entities' JOIN w ON w.item_id = x.item_id WHERE x.kind = 'all')"""


@query("WITH RECURSIVE " + _BOTH + " SELECT item_id, round(wer, 4) AS wer, round(entity_wer, 4) AS entity_wer, fabricated FROM heard")
def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("item_id", F.round("wer", 4).alias("wer"), F.round("entity_wer", 4).alias("entity_wer"), "fabricated")


@query("WITH RECURSIVE " + _BOTH + " SELECT item_id, round(wer, 4) AS wer FROM heard")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("item_id", F.round("wer", 4).alias("wer"))


@query("WITH RECURSIVE " + _BOTH + " SELECT item_id, round(entity_wer, 4) AS entity_wer FROM heard")
def entity_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("item_id", F.round("entity_wer", 4).alias("entity_wer"))


@query(
    "WITH " + _WORDS + " SELECT item_id, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x) AND NOT list_contains(["
    + ", ".join(f"'{x}'" for x in FILLERS) + "], x))) AS INT) AS fabricated FROM w"
)
def fabricated_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("item_id", "fabricated")


@query(
    "WITH RECURSIVE " + _BOTH + """, runs AS (SELECT h.*, 'm' || (h.item_id % 3) AS model, CASE WHEN h.item_id % 4 < 2 THEN 'denoised' ELSE 'none' END AS preprocessing, h.item_id % 5 = 0 AS context_biasing, CASE WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS category, coalesce(value, 0) AS latency_ms
      FROM heard h JOIN benchmark USING (item_id) LEFT JOIN events ON event_id = h.item_id)
    SELECT model, preprocessing, context_biasing, round(avg(wer), 4) AS avg_wer, round(avg(entity_wer), 4) AS avg_entity_wer, round(avg(fabricated), 2) AS avg_fabricated, round(avg(latency_ms), 1) AS avg_latency_ms,
    round(coalesce(avg(wer) FILTER (category = 'A'), 0), 4) AS cat_a_wer, round(coalesce(avg(wer) FILTER (category = 'B'), 0), 4) AS cat_b_wer, round(coalesce(avg(entity_wer) FILTER (category = 'B'), 0), 4) AS cat_b_entity_wer FROM runs GROUP BY ALL"""
)
def transcript_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transcripts(spark, sf_dir).selectExpr(
        "*", "concat('m', item_id % 3) AS model", "CASE WHEN item_id % 4 < 2 THEN 'denoised' ELSE 'none' END AS preprocessing", "item_id % 5 = 0 AS context_biasing", "CASE WHEN length(ground_truth) % 2 = 0 THEN 'A' ELSE 'B' END AS category"
    )
    spent = view(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("value").alias("latency_ms"))
    return ev.transcript_summary(t.join(spent, "item_id", "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0))))


_TRUTH = "truth AS (SELECT source_id, CAST(n AS VARCHAR) AS n FROM legal, range(1, 8) x(n))"


@query(with_(LEGAL, _TRUTH) + "SELECT source_id, round(avg(CAST(contains(full_text, 'Article ' || n) OR contains(full_text, 'Art. ' || n) AS INT)), 4) AS score FROM legal JOIN truth USING (source_id) GROUP BY source_id")
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = legal_docs(spark, sf_dir)
    truth = d.select("source_id", F.explode(F.array(*(F.lit(str(n)) for n in range(1, 8)))).alias("n"))
    return ev.named_share(d, truth, "n", "score").select("source_id", F.round("score", 4).alias("score"))


@query(with_(LEGAL) + "SELECT l.source_id, round(avg(CAST(contains(l.full_text, 'Article ' || n) OR contains(l.full_text, 'Art. ' || n) AS INT)), 4) AS rate FROM legal l JOIN (SELECT source_id, CAST(doc_id % 11 + x.k AS VARCHAR) AS n FROM legal, (VALUES (1), (5)) x(k)) t USING (source_id) GROUP BY 1")
def cross_ref_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = legal_docs(spark, sf_dir)
    truth = d.select("source_id", F.explode(F.array((F.col("doc_id") % 11 + 1).cast("string"), (F.col("doc_id") % 11 + 5).cast("string"))).alias("n"))
    return ev.named_share(d, truth, "n", "rate").select("source_id", F.round("rate", 4).alias("rate"))


@query(
    with_(LEGAL) + """SELECT l.source_id, round(coalesce(avg(CAST(contains(l.full_text, substr(n.note, 1, 30)) AS INT)), 1), 4) AS footnote_rate FROM legal l
    LEFT JOIN (SELECT 'doc' || doc_id AS source_id, substr(text, 10, 60) AS note FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'doc' || doc_id, 'no such note ' || doc_id FROM documents WHERE doc_id % 4 = 0) n USING (source_id) GROUP BY 1"""
)
def footnote_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents")
    notes = d.where("doc_id % 2 = 0").selectExpr("concat('doc', doc_id) AS source_id", "substr(text, 10, 60) AS note").unionByName(d.where("doc_id % 4 = 0").selectExpr("concat('doc', doc_id) AS source_id", "concat('no such note ', doc_id) AS note"))
    return ev.footnote_rate(legal_docs(spark, sf_dir), notes).select("source_id", F.round("footnote_rate", 4).alias("footnote_rate"))


@query(
    """WITH o AS (SELECT o_custkey AS source_id, o_orderkey % 3 AS page, o_orderkey AS table_id, [CAST(o_orderkey AS VARCHAR), o_orderpriority, ' ' || o_orderstatus || ' '] AS cells FROM orders),
    f AS (SELECT source_id, page, [lower(cells[2]), lower(trim(cells[3]))] AS rows FROM o WHERE table_id % 2 = 0),
    s AS (SELECT o.source_id, o.page, o.table_id, max(CASE WHEN f.rows IS NULL THEN 0 ELSE len(list_filter(o.cells, lambda x: list_contains(f.rows, lower(trim(x))))) / 3.0 END) AS best FROM o LEFT JOIN f USING (source_id, page) GROUP BY 1, 2, 3)
    SELECT source_id, round(CAST(avg(best) AS DOUBLE), 4) AS table_recall FROM s GROUP BY source_id"""
)
def table_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "orders").selectExpr("o_custkey AS source_id", "o_orderkey % 3 AS page", "o_orderkey AS table_id", "array(array(cast(o_orderkey as string), o_orderpriority, concat(' ', o_orderstatus, ' '))) AS cells")
    found = o.where("table_id % 2 = 0").selectExpr("source_id", "page", "array(array(cells[0][1], trim(cells[0][2]))) AS rows")
    return ev.table_recall(o, found)


@query(_LABELS + "SELECT query_id, source_id, chunk_index, level FROM labels")
def label_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("chunk_id", "#")
    return _labels(spark, sf_dir).select("query_id", F.get(parts, F.lit(0)).alias("source_id"), F.get(parts, F.lit(1)).cast("long").alias("chunk_index"), "level")


@query(
    with_(LEGAL, _TRUTH) + """, timed AS (SELECT 'doc' || doc_id AS source_id, (200 * CAST(sum(length(l)) AS BIGINT) + count(*)) // (2 * count(*)) / 100.0 AS ms_per_page FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) GROUP BY doc_id)
    SELECT source_id, round(avg(CAST(contains(full_text, 'Article ' || n) OR contains(full_text, 'Art. ' || n) AS INT)), 4) AS structure, ms_per_page FROM legal JOIN truth USING (source_id) JOIN timed USING (source_id) GROUP BY source_id, ms_per_page"""
)
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = legal_docs(spark, sf_dir)
    truth = d.select("source_id", F.explode(F.array(*(F.lit(str(n)) for n in range(1, 8)))).alias("n"))
    lines = view(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("source_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "content"))
    pages = assembled(lines.withColumn("ms", F.length("content").cast("double")))
    return ev.named_share(d, truth, "n", "structure").select("source_id", F.round("structure", 4).alias("structure")).join(ev.ms_per_page(pages), "source_id")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings WHERE ql % 2 = 0 OR label IN (ql, ql - 1))
    SELECT query_id, chunk_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM p) WHERE r <= 5"""
)
def retrieve_for_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "embeddings")
    own = F.when(F.col("label") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array("label", F.col("label") - 1))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), own.alias("labels"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    return se.top_k(q, c, 5, {"label": "labels"}).select("query_id", "chunk_id", "rank")


@query(
    "SELECT conv_id, turn, CASE WHEN text = '' OR text IS NULL THEN 'insufficient_evidence' ELSE CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in tx.UNCERTAIN) + " THEN 'insufficient_evidence' ELSE 'sufficient' END END AS confidence FROM conversations WHERE role = 'assistant'"
)
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.coalesce("text", F.lit("")) == ""
    return view(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(empty | tx.says_any(F.col("text")), "insufficient_evidence").otherwise("sufficient").alias("confidence"))


#: The featuriser in SQL: counts of hashed words, weighted by rarity, at length one.
_MODEL = """tokens AS (SELECT k, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w FROM texts),
dims AS (SELECT k, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 256 AS dim FROM tokens),
idf AS (SELECT CAST(d AS INT) AS dim, ln(((SELECT count(*) FROM texts) + 1) / CAST(coalesce(n, 0) + 1 AS DOUBLE)) AS idf FROM range(256) r(d) LEFT JOIN (SELECT dim, count(DISTINCT k) AS n FROM dims GROUP BY dim) ON dim = d)"""


@query("WITH texts AS (SELECT doc_id AS k, text FROM documents), " + _MODEL + "SELECT dim, round(idf, 9) AS idf, (SELECT count(*) FROM texts) AS documents FROM idf")
def fit_text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.fitted(view(spark, sf_dir, "documents"), "text").select("dim", F.round("idf", 9).alias("idf"), "documents")


@query(
    "WITH texts AS (SELECT doc_id AS k, text FROM documents), " + _MODEL + """, parts AS (SELECT k, dim, count(*) * any_value(idf) AS x FROM dims JOIN idf USING (dim) GROUP BY k, dim),
    tops AS (SELECT k, sqrt(sum(x * x)) AS norm FROM parts GROUP BY k)
    SELECT texts.k AS doc_id, 256 AS dims, round(coalesce(sum(x * x) / any_value(norm * norm), 0), 6) AS length, round(coalesce(sum(x * (dim % 16)) / any_value(norm), 0), 6) AS digest FROM texts LEFT JOIN parts ON parts.k = texts.k AND x > 0 LEFT JOIN tops ON tops.k = texts.k GROUP BY texts.k"""
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = se.embedded(d, "text", stored(se.fitted(d, "text"), "model"))
    digest = F.aggregate(F.transform("vec", lambda x, i: x * (i % 16)), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("doc_id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.round(digest, 6).alias("digest"))
