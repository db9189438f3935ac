"""Periodic runs of words: seed and extend on the diagonals of each document.

A run is a stretch of consecutive words with smallest period q and at least
max(6, 4 q) words, which neither neighbour extends.  At lag q its words meet
themselves in an overlap of max(6, 4 q) - q words or more.  Lags are dealt to
classes (2**(t-1), 2**t]; the k-grams of class t have the least overlap that
its lags guarantee, which is never shorter than its longest lag.  Hence, inside
a run, the next occurrence of a k-gram lies exactly one period on (nearer would
mean a smaller period), so pairs of neighbouring occurrences are all the pairs
that a class needs.  Runs of seeds on one diagonal are extended by comparing
words, and a table of the furthest word covered at each lag keeps a stretch
from being extended twice.

Grams get exact names by doubling: the name of a gram is that of its two
halves, which may overlap.  Only places whose gram occurs again in the document
stay, so plain text costs little beyond its first two or three doublings.  The
work is n log(n) words at worst, whatever the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes
from .sql import crc32_sql, words_sql

LEAST_WORDS, LEAST_PERIODS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


def regrouped(names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of grams longer by `step`, -1 where such a gram occurs once; the places of the others by gram and place, and which of them begin a gram."""
    at = np.flatnonzero(names[: len(names) - step] >= 0) if step < len(names) else np.zeros(0, np.int64)
    at = at[names[at + step] >= 0]
    key = names[at] * len(names) + names[at + step]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    group = np.cumsum(begins) - 1
    again = np.bincount(group)[group] > 1
    out = np.full(len(names), -1, np.int64)
    out[at[again]] = group[again]
    return out, at[again], begins[again]


def seeds(at: np.ndarray, begins: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of neighbouring occurrences of a gram at lags in (low, high], sorted."""
    lag = np.diff(at)
    found = np.flatnonzero(~begins[1:] & (lag > low) & (lag <= high))
    lag, place = lag[found], at[found]
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def agreeing(words: np.ndarray, x: int, lag: int, step: int) -> int:
    """How many words from x on (step 1), or before x (step -1), equal those `lag` further."""
    met, size = 0, 64
    while True:
        if step > 0:
            end = min(x + met + size, len(words) - lag)
            same = words[x + met : end] == words[x + met + lag : end + lag]
        else:
            end = max(x - met - size, 0)
            same = (words[end : x - met] == words[end + lag : x - met + lag])[::-1]
        if not same.all():
            return met + int(np.argmin(same))
        met += len(same)
        if len(same) < size:
            return met
        size *= 2


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    `words` are numbers below len(words), those of different documents
    different, so that no gram of two documents or across their border occurs
    twice; `longest` is the length of the longest document.
    """
    found = []
    names, have = regrouped(words, 0)[0], 1
    t = 0
    while True:
        low, high = (1 << t) >> 1, 1 << t
        k = max(LEAST_WORDS, LEAST_PERIODS * (low + 1)) - (low + 1)
        if max(LEAST_WORDS, LEAST_PERIODS * (low + 1)) > longest or not (names >= 0).any():
            break
        while 2 * have <= k:
            names, have = regrouped(names, have)[0], 2 * have
        lags, places = seeds(*regrouped(names, k - have)[1:], low, high)
        # seeds of one diagonal that overlap or touch are one stretch
        first = np.ones(len(lags), bool)
        first[1:] = (lags[1:] != lags[:-1]) | (places[1:] > places[:-1] + k)
        covered: dict[int, int] = {}
        begin = np.flatnonzero(first)
        ends = places[np.append(begin[1:], len(lags)) - 1] + k if len(begin) else begin
        for lag, a, b in zip(lags[begin].tolist(), places[begin].tolist(), ends.tolist(), strict=True):
            if a < covered.get(lag, 0):
                continue
            a -= agreeing(words, a, lag, -1)
            b += agreeing(words, b, lag, 1)
            covered[lag] = b
            if b - a + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((a, b - a + lag, lag))
        t += 1
    return np.array(sorted((a, q, n) for a, n, q in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers; equal words of one text are equal, no others."""
    out, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, runs (start, length, period in words, by start and period) and the collapsed text.

    The collapsed text has the words that no run contains after its first
    period, joined by single spaces.  Null and empty texts have no runs and an
    empty collapsed text; repeated rows each give a row, null keys too; other
    columns are ignored; an empty table gives no row.  Every text is read
    whole, and a row never leaves its partition: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[key], docs[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.split() for x in utf8_bytes(batch.column(1))]
            ends = np.cumsum([len(w) for w in texts], dtype=np.int64)
            runs = runs_of(numbered(texts), max(map(len, texts), default=0))
            cuts = np.searchsorted(runs[:, 0], ends)
            spans, kept, at, begin = [], [], 0, 0
            for words, end, cut in zip(texts, ends.tolist(), cuts.tolist(), strict=True):
                own = runs[at:cut] - np.array([begin, 0, 0])
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                if len(own):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, own[:, 0] + own[:, 2], 1)
                    np.add.at(change, own[:, 0] + own[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
                at, begin = cut, end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(struct)), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])

    return source.mapInArrow(run, f"`{key}` {kind}, runs {RUNS}, collapsed string")


def damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic tails planted: let h = crc32(doc_id as text), g = h div 10; in texts with h % 10 = 0 and n > 0 words,
    each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    # the words of a text that stays as it is are never cut out
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("words", words).withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equal ones the first by start, then period; null without runs.

    The quotients are exact enough: of different fractions of whole numbers below 2**26 no two share a double.
    """
    return F.array_sort(runs, lambda x, y: F.when(x["length"] / x["period"] > y["length"] / y["period"], -1).when(x["length"] / x["period"] < y["length"] / y["period"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.signum(x["period"] - y["period"]).cast("int"))).getItem(0)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.when(F.size("runs") > 0, strongest(F.col("runs")))
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: All pairs of equal words of a document at every lag, in islands.
SQL = rf"""WITH {crc32_sql("h", "SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS crc_of FROM documents")},
base AS (SELECT doc_id, crc, {words_sql("text")} AS w FROM h),
forms AS (SELECT doc_id, w, len(w) AS n, crc, crc // 10 AS g, CASE WHEN crc % 10 = 0 AND len(w) > 0 THEN (crc // 10) % len(w) END AS a FROM base),
docs AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM forms),
words AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM islands WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS text, first({{'s': s, 'len': len, 'q': q}} ORDER BY len / CAST(q AS DOUBLE) DESC, s, q) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(o.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l USING (doc_id) LEFT JOIN left_over o USING (doc_id)"""
