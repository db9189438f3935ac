"""Quality rules with a verdict on hosts: native DataFrame functions only.

Rules look at what is wrong within one text.  Hosts (here the `source` of a
document) are judged rule by rule: the share of their documents that fail has a
beta prior fitted to all hosts by moments, so that a host with a few documents
needs more evidence than one with many.  A host is rejected where its posterior
leaves no doubt (SURE standard deviations) that its share is over TIMES that of
the corpus, and over LEAST_RATE.  Verdicts go back to the documents by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
#: What a document fails, over its base counts. The first two are the base rules, which also decide on the document.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "20 * n_dup_lines > n_words",
}
TIMES, LEAST_RATE, SURE = 3.0, 0.3, 2.33
WEAKEST, STRONGEST = 2.0, 10000.0


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Every step is a projection; an array that later steps use more than once is
    a column of its own, so that it is computed once.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(docs[key].alias("k"), docs[host].cast("string").alias("host"), t.alias("t"))
    d = d.select("k", "host", "t", F.expr(r"filter(split(t, '[ \\t-\\r]+'), x -> x <> '')").alias("w"), F.expr(r"filter(split(t, '\n'), x -> x rlike '[^ \\t-\\r]')").alias("lines"))
    d = d.select(
        "k", "host",
        F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as long)").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    five = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    counts = ["k", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    d = d.select(*counts, F.expr(f"case when size(h) > {WINDOW} then transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({five})) else cast(array() as array<bigint>) end").alias("windows"))
    repeats = "size(windows) > size(array_distinct(windows))"
    d = d.select(*counts, F.expr(f"case when {repeats} then sort_array(transform(windows, (x, i) -> named_struct('x', x, 'i', i))) end").alias("s"))
    d = d.select(*counts, F.expr("sort_array(transform(filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false)), e -> e.i))").alias("p"))
    covered = f"aggregate(transform(p, (e, k) -> least({WINDOW}, coalesce(get(p, k + 1) - e, {WINDOW}))), 0L, (n, e) -> n + e)"
    d = d.select(*counts, F.expr(f"coalesce({covered}, 0L)").alias("n_repeat_words"))
    failed: Column = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    return d.select(F.col("k").alias(key), *counts[1:], "n_repeat_words", failed.alias("base_failed"))


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(host, host_rule, host_rate) for every host: the first rule that rejects it, if any, and its greatest shrunken share.

    With mean share m over all documents and variance v between hosts (the
    variance of their shares less what chance gives), a rule's prior has the
    strength m (1 - m) / v - 1, held between WEAKEST and STRONGEST.
    """
    bad = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = counts.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *bad)
    squares = [F.sum(F.col(x) * F.col(x) / F.col("n")).alias(f"{x}_squares") for x in RULES]
    total = hosts.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), *(F.sum(x).alias(x) for x in RULES), *squares).first()
    docs = total.docs or 1
    judged, rates = [], []
    for name in RULES:
        m = (total[name] or 0) / docs
        noise = m * (1 - m)
        between = (total[f"{name}_squares"] or 0.0) / docs - m * m - noise * total.hosts / docs
        strength = min(STRONGEST, max(WEAKEST, noise / between - 1)) if between > 0 else STRONGEST
        a, b = F.col(name) + F.lit(m * strength), F.col("n") - F.col(name) + F.lit((1 - m) * strength)
        rate = a / (a + b)
        bound = rate - SURE * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        judged.append(F.when(bound > max(TIMES * m, LEAST_RATE), F.lit(name)))
        rates.append(rate)
    return hosts.select("host", F.coalesce(*judged).alias("host_rule"), F.greatest(*rates).alias("rate"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules, host_rule, host_rate.

    Null and empty texts have no words and fail.  A null host has no verdict
    (host_rate is null): the base rules alone decide.  Repeated rows each count
    and each give a row; a null key stays null; other columns are ignored; an
    empty table gives no row.
    """
    counts = written(base_counts(docs, key, text, host), "counts")
    # a written table: its size is known when the join is planned, so few hosts need no exchange of the documents
    joined = counts.join(written(host_verdicts(counts), "hosts"), "host", "left")
    kept = ~F.col("base_failed") & F.col("host_rule").isNull()
    failed = F.concat_ws(",", *(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(key, *base, kept.alias("kept"), failed.alias("failed_rules"), "host_rule", F.round("rate", 6).alias("host_rate"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN covered USING (doc_id)),
r AS ({" UNION ALL ".join(f"SELECT host, {k} AS k, '{name}' AS rule, CAST({rule} AS INT) AS failed FROM c WHERE host IS NOT NULL" for k, (name, rule) in enumerate(RULES.items()))}),
h AS (SELECT host, k, rule, count(*) AS n, sum(failed) AS bad FROM r GROUP BY host, k, rule),
m AS (SELECT rule, sum(bad) / CAST(sum(n) AS DOUBLE) AS m, sum(bad * bad / CAST(n AS DOUBLE)) / sum(n) AS squares, count(*) / CAST(sum(n) AS DOUBLE) AS noise FROM h GROUP BY rule),
s AS (SELECT rule, m, squares - m * m - m * (1 - m) * noise AS between_hosts FROM m),
p AS (SELECT rule, m, CASE WHEN between_hosts > 0 THEN least({STRONGEST}, greatest({WEAKEST}, m * (1 - m) / between_hosts - 1)) ELSE {STRONGEST} END AS strength FROM s),
ab AS (SELECT host, k, rule, m, bad + m * strength AS a, n - bad + (1 - m) * strength AS b FROM h JOIN p USING (rule)),
b AS (SELECT host, k, rule, a / (a + b) AS rate, a / (a + b) - {SURE} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > greatest({TIMES} * m, {LEAST_RATE}) AS bad FROM ab),
v AS (SELECT host, arg_min(rule, k) FILTER (bad) AS host_rule, max(rate) AS rate FROM b GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rule IS NULL AS kept,
       concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}) AS failed_rules, host_rule, round(rate, 6) AS host_rate
FROM c LEFT JOIN v USING (host)
"""
