"""URL filters: stated rules first, then naive Bayes over segmented host and path words.

Letters of hosts and paths are cut in runs, and each distinct run is segmented
by unigram Viterbi.  Word counts come from the text of all pages; a run meets
them by a join on its substrings, so the vocabulary is never broadcast.  The
classes are learned from the pages that a rule decides; a run's log odds are
the sum over its words, a page's the prior plus the sum over its runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Letters of a vocabulary word or unknown piece at most; longer runs are several of them.
LONGEST_WORD = 20
NUMBER = "#"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end; only A-Z are lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[Rule, ...], host: str = "host", path: str = "path") -> Column:
    """The text of the longest rule that fits; of equally long ones the least."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def runs_of(host: str = "host", path: str = "path") -> Column:
    """Runs of a page: letters of host and path in lower case; a number in the path is one sign."""
    numbered = F.regexp_replace(F.lower(F.concat(F.col(host), F.lit("/"), F.col(path))), r"\d+", f" {NUMBER} ")
    return F.filter(F.split(numbered, r"[^\p{L}#]+"), lambda x: x != "")


def segments(run: str, matches: list[tuple[int, str, int]], total: float) -> list[str]:
    """The most likely words of a run; matches are (begin, word, count). An unknown piece gets longer at a steep price."""
    words: dict[int, list[tuple[str, float]]] = {}
    for begin, word, count in matches:
        words.setdefault(begin, []).append((word, math.log(count / total)))
    unknown = -math.log(total) - 2.3
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(run)
    for i in range(len(run)):
        score = best[i][0]
        for word, logp in words.get(i, ()):
            j = i + len(word)
            if score + logp > best[j][0]:
                best[j] = (score + logp, i)
        for size in range(1, LONGEST_WORD + 1):
            j = i + size
            if j > len(run):
                break
            if score + unknown - 2.3 * size > best[j][0]:
                best[j] = (score + unknown - 2.3 * size, i)
    out, at = [], len(run)
    while at:
        out.append(run[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def vocabulary(texts: DataFrame, text: str = "html") -> DataFrame:
    """(word, count) of the visible text of all rows: letters, lower case, at most LONGEST_WORD of them.

    A single letter is a word only if it stands for itself often; it takes part like any other.
    """
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>|&\w+;", " ")
    words = texts.select(F.explode_outer(F.split(F.lower(shown), r"\P{L}+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def segmented(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, words) for distinct runs: their substrings are joined with the vocabulary, then Viterbi picks."""
    bounded_batches(runs.sparkSession)
    begins = F.sequence(F.lit(0), F.length("run") - 1)
    pieces = runs.select("run", F.explode(begins).alias("begin")).select("run", "begin", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("begin")))).alias("size"))
    pieces = pieces.select("run", "begin", F.substring("run", F.col("begin") + 1, F.col("size")).alias("word"))
    found = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("begin", "word", "count")).alias("matches"))
    whole = runs.join(found, "run", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [segments(r, [(m["begin"], m["word"], m["count"]) for m in ms or ()], total) for r, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.string()))], names=["run", "words"])

    return whole.select("run", "matches").mapInArrow(run, "run string, words array<string>")


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, host, path, rule (null if none fits), verdict, log_odds (above 0: block; null if a rule decides).

    A null url, or one without ://, has an empty host and path, fits no rule
    and gets the verdict of the prior.  Without any page that a rule decides
    all others are allowed.  Repeated rows each count and each give a row;
    other columns are ignored; an empty table gives no row.
    """
    plain = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    judged = plain.select(key, host_of().alias("host"), path_of().alias("path")).withColumn("rule", rule_of(rules))
    blocking = F.col("rule").isin([r.text for r in rules if r.verdict == "block"])
    # what counts is host, path and rule: repeats are added up before anything else
    kinds = written(judged.groupBy("host", "path", "rule").agg(F.count(F.lit(1)).alias("pages")).withColumn("runs", runs_of()), "kinds")
    each = kinds.select("host", "path", "rule", "pages", F.explode("runs").alias("run"))
    runs = written(
        each.groupBy("run").agg(F.coalesce(F.sum(F.when(blocking, F.col("pages"))), F.lit(0)).alias("block"), F.coalesce(F.sum(F.when(F.col("rule").isNotNull() & ~blocking, F.col("pages"))), F.lit(0)).alias("allow")), "runs"
    )
    words = written(vocabulary(pages, html), "vocabulary")
    total = (words.agg(F.sum("count")).first()[0] or 0) + 1
    split = written(segmented(runs.where(f"run <> '{NUMBER}'").select("run"), words, total).unionByName(runs.where(f"run = '{NUMBER}'").select("run", F.array("run").alias("words"))), "segments")
    tokens = split.select("run", F.explode("words").alias("token"))
    counted = written(tokens.join(runs, "run").groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    sums = counted.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    shown = kinds.agg(F.sum(F.when(blocking, F.col("pages"))), F.sum(F.when(F.col("rule").isNotNull() & ~blocking, F.col("pages")))).first()
    block, allow, size = sums[0] or 0, sums[1] or 0, max(1, sums[2])
    learned = bool(shown[0] or shown[1])
    prior = math.log(((shown[0] or 0) + 1) / ((shown[1] or 0) + 1))
    odds = counted.select("token", F.log((F.col("block") + 1) / F.lit(float(block + size)) / ((F.col("allow") + 1) / F.lit(float(allow + size)))).alias("odds"))
    scored = written(tokens.join(odds, "token").groupBy("run").agg(F.sum("odds").alias("odds")), "scores")
    open_kinds = each.where("rule is null").select("host", "path", "run")
    method = written(open_kinds.join(scored, "run").groupBy("host", "path").agg((F.sum("odds") + prior).alias("log_odds")), "method")
    out = judged.join(method, ["host", "path"], "left").withColumn("log_odds", F.when(F.col("rule").isNull(), F.coalesce("log_odds", F.lit(prior))))
    verdict = F.when(blocking, "block").when(F.col("rule").isNotNull(), "allow").when((F.col("log_odds") > 0) & F.lit(learned), "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.round("log_odds", 6).alias("log_odds"))
