"""Structure-aware chunking: every document is cut within its own row, so no step shuffles.

Spans are parts of a text before a lookahead boundary; a document's chunks are
one array, whose positions are the chunk numbers.  Generators are outer ones
with a filter behind them: for the others the optimizer tests the array first,
which computes it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_TOKENS, OVERLAP_TOKENS, LEAST_TOKENS = 512, 64, 20
LOOK_BACK = 500
BLOCK = 128


def window_sizes(max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> tuple[int, int]:
    size, overlap = int(max_tokens / tx.TOKENS_PER_WORD), int(overlap_tokens / tx.TOKENS_PER_WORD)
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    return size, overlap


def lookahead(pattern: str) -> str:
    """A pattern that matches the empty string before each match of the given one (flags first)."""
    flags, _, rest = pattern.partition(")")
    return f"{flags})(?={rest})"


def by_source(of: Callable[[str], str], source: Column | None) -> Column:
    """of(pattern) for the article pattern of a source: its own, or the one of all forms."""
    out = F.lit(of(tx.ARTICLE))
    for name, pattern in tx.OWN_ARTICLE.items() if source is not None else ():
        out = F.when(source == name, F.lit(of(pattern))).otherwise(out)
    return out


def parts(text: Column, pattern: str) -> Column:
    """The text cut before each match; what stands before the first match is the first part."""
    return F.split(text, lookahead(pattern))


def at_start(pattern: str) -> str:
    return pattern.replace("(?md)^", r"(?md)\A", 1)


def label_of(part: Column, pattern: str) -> Column:
    """The label that a part starts with, null if it does not start with a match."""
    return F.nullif(F.regexp_extract(part, at_start(pattern), 1), F.lit(""))


def windows(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Overlapping windows of words, joined by single spaces; none for a text without words."""
    size, overlap = window_sizes(max_tokens, overlap_tokens)

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - overlap - 1), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")), lambda x: x != "")

    return tx.let(tx.words(text), of)


def running_sums(sizes: Column) -> Column:
    """For each element the sum of those before it, by sums of blocks, so that no long prefix is summed per element."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda at: total(F.slice(all_, at + 1, F.lit(BLOCK))))

        def within(sums: Column) -> Column:
            starts = F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
            start = lambda s, i: F.get(s, F.floor(i / BLOCK).cast("int")) + total(F.slice(all_, i - F.pmod(i, F.lit(BLOCK)) + 1, F.pmod(i, F.lit(BLOCK))))
            return tx.let(starts, lambda s: F.transform(all_, lambda _, i: start(s, i)))

        return tx.let(blocks, within)

    return tx.let(sizes, of)


def placed_parts(text: Column, source: Column | None = None) -> Column:
    """Array of (part, label, start): the text cut before each article, with the article's label, if any, and its offset."""

    def of(cut: Column) -> Column:
        def label(p: Column) -> Column:
            return F.nullif(F.call_function("regexp_extract", p, by_source(at_start, source), F.lit(1)), F.lit(""))

        starts = running_sums(F.transform(cut, lambda p: F.length(p)))
        return tx.let(starts, lambda s: F.transform(cut, lambda p, i: F.struct(p.alias("part"), label(p).alias("label"), F.get(s, i).alias("start"))))

    return tx.let(F.split(text, by_source(lookahead, source), -1), of)


def regex_spans(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(all columns but the text, position from 1, label, start, span) for every article, as its source writes them."""
    source = F.col("source_id") if "source_id" in docs.columns else None
    spans = F.filter(placed_parts(F.col(text), source), lambda s: s["label"].isNotNull())
    each = docs.select(*(c for c in docs.columns if c != text), F.posexplode_outer(spans).alias("_k", "_s")).where("_k is not null")
    return each.withColumn("position", F.col("_k") + 1).select("*", "_s.label", "_s.start", F.col("_s.part").alias("span")).drop("_k", "_s")


def _chunk(text: Column, article: Column, paragraph: Column, chapter: Column, section: Column) -> Column:
    return F.struct(text.alias("text"), article.alias("article"), paragraph.alias("paragraph"), chapter.alias("chapter"), section.alias("section"))


def _windows(text: Column, article: Column, paragraph: Column, chapter: Column, section: Column) -> Column:
    return F.transform(windows(text), lambda w: _chunk(w, article, paragraph, chapter, section))


def _null() -> Column:
    return F.lit(None).cast("string")


def numbered_parts(text: Column, pattern: str) -> Column:
    return F.filter(parts(text, pattern), lambda p: label_of(p, pattern).isNotNull())


def paragraph_chunks(article_text: Column, article: Column, chapter: Column, section: Column) -> Column:
    """A long article by numbered paragraphs; what stands before the first is dropped, long ones are windowed without section."""

    def one(p: Column) -> Column:
        def of(body: Column) -> Column:
            whole = F.array(_chunk(body, article, label_of(p, tx.PARAGRAPH), chapter, section))
            return F.when(tx.estimate_tokens(body) <= MAX_TOKENS, whole).otherwise(_windows(body, article, label_of(p, tx.PARAGRAPH), chapter, _null()))

        return tx.let(tx.strip(p), of)

    whole = _windows(article_text, article, _null(), chapter, _null())
    return tx.let(numbered_parts(article_text, tx.PARAGRAPH), lambda n: F.when(F.size(n) == 0, whole).otherwise(F.flatten(F.transform(n, one))))


def recital_chunks(preamble: Column) -> Column:
    """A preamble by recitals; what stands before the first is dropped, and without any it is one chunk."""
    whole = F.array(_chunk(preamble, _null(), F.lit("Preamble"), _null(), _null()))

    def one(p: Column) -> Column:
        return _chunk(tx.strip(p), _null(), F.concat(F.lit("Recital "), label_of(p, tx.RECITAL)), _null(), _null())

    return tx.let(numbered_parts(preamble, tx.RECITAL), lambda n: F.when(F.size(n) == 0, whole).otherwise(F.transform(n, one)))


def last_match(text: Column, pattern: str) -> Column:
    return F.element_at(F.concat(F.array(_null()), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), -1)


def carried(labels: Column) -> Column:
    """Each element or else the last one before it that is not null: every one that is not null, as often as its turn lasts."""

    def of(all_: Column) -> Column:
        places = F.filter(F.transform(all_, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

        def repeated(at: Column) -> Column:
            turn = F.flatten(F.transform(at, lambda p, k: F.array_repeat(F.get(all_, p), F.coalesce(F.get(at, k + 1), F.size(all_)) - p)))
            return F.concat(F.array_repeat(_null(), F.coalesce(F.get(at, F.lit(0)), F.size(all_))), turn)

        return tx.let(places, repeated)

    return tx.let(labels, of)


def headed_spans(docs: DataFrame) -> DataFrame:
    """Adds `_pre` (stripped text before the first article) and `_spans` (label, text, chapter, section per article).

    Chapter and section are the last that stand in the LOOK_BACK characters
    before an article, or else those of the article before.
    """
    most = LOOK_BACK // len("Art. 1") + 1  # so many parts have these characters

    def of(placed: Column) -> Column:
        first = F.get(placed, F.lit(0))
        pre = F.when(first["label"].isNull(), tx.strip(first["part"]))

        def before(i: Column) -> Column:
            def near(n: int) -> Column:
                return F.array_join(F.transform(F.slice(placed, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))), lambda p: p["part"]), "")

            # mostly the last part or the last few have these characters
            long = lambda n: F.get(placed, i)["start"] - F.get(placed, F.greatest(i - n, F.lit(0)))["start"] >= LOOK_BACK
            return F.right(F.when(long(1), F.get(placed, i - 1)["part"]).when(long(4), near(4)).when(long(16), near(16)).otherwise(near(most)), F.lit(LOOK_BACK))

        both = F.transform(placed, lambda p, i: F.when(p["label"].isNotNull() & (i > 0), tx.let(before(i), lambda b: F.struct(last_match(b, tx.CHAPTER).alias("chapter"), last_match(b, tx.SECTION).alias("section")))))

        def with_headings(chapters: Column, sections: Column) -> Column:
            each = F.transform(placed, lambda s, i: F.struct(s["label"].alias("label"), tx.strip(s["part"]).alias("text"), F.get(chapters, i).alias("chapter"), F.get(sections, i).alias("section")))
            return F.filter(each, lambda s: s["label"].isNotNull())

        own = lambda h, name: carried(F.transform(h, lambda x: x[name]))
        spans = tx.let(both, lambda h: tx.let(own(h, "chapter"), lambda c: tx.let(own(h, "section"), lambda e: with_headings(c, e))))
        return F.struct(pre.alias("pre"), spans.alias("spans"))

    d = docs.withColumn("_h", tx.let(placed_parts(F.col("full_text"), F.col("source_id")), of))
    return d.select(*docs.columns, F.col("_h.pre").alias("_pre"), F.col("_h.spans").alias("_spans"))


def statute_chunks(docs: DataFrame) -> DataFrame:
    """Adds `_chunks` to statutes: preamble, then articles, long ones by paragraphs; windows if there is no article."""
    d = headed_spans(docs)

    def one(s: Column) -> Column:
        whole = F.array(_chunk(s["text"], s["label"], _null(), s["chapter"], s["section"]))
        return F.when(tx.estimate_tokens(s["text"]) <= MAX_TOKENS, whole).otherwise(paragraph_chunks(s["text"], s["label"], s["chapter"], s["section"]))

    def lead(pre: Column) -> Column:
        plain = F.array(_chunk(pre, _null(), F.lit("Preamble"), _null(), _null()))
        got = F.when(F.col("source_id") == "gdpr", recital_chunks(pre)).otherwise(plain)
        return F.when(pre.isNotNull() & (tx.estimate_tokens(pre) > LEAST_TOKENS), got).otherwise(F.slice(plain, 1, 0))

    def of(spans: Column) -> Column:
        chunks = F.concat(tx.let(F.col("_pre"), lead), F.flatten(F.transform(F.filter(spans, lambda s: s["text"] != ""), one)))
        none = _windows(F.col("full_text"), _null(), _null(), _null(), _null())
        return F.when(F.size(spans) == 0, none).otherwise(chunks)

    return d.withColumn("_chunks", tx.let(F.col("_spans"), of)).select(*docs.columns, "_chunks")


def section_chunks(text: Column, label: Column) -> Column:
    whole = F.array(_chunk(text, _null(), _null(), _null(), label))
    return F.when(tx.estimate_tokens(text) <= MAX_TOKENS, whole).otherwise(_windows(text, _null(), _null(), _null(), label))


def toc_chunks(text: Column, toc: Column) -> Column:
    """Sections between the first occurrences of the titles, in their order in the text; short ones are dropped."""
    places = F.filter(F.transform(toc, lambda t: F.struct(F.instr(text, t).alias("at"), t.alias("title"))), lambda b: b["at"] > 0)

    def of(found: Column) -> Column:
        def section(b: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["at"], F.length(text) + 1)
            return F.struct(b["title"].alias("title"), tx.strip(F.substring(text, b["at"], end - b["at"])).alias("text"))

        long = F.filter(F.transform(found, section), lambda s: tx.estimate_tokens(s["text"]) >= LEAST_TOKENS)
        none = _windows(text, _null(), _null(), _null(), _null())
        return F.when(F.size(found) == 0, none).otherwise(F.flatten(F.transform(long, lambda s: section_chunks(s["text"], s["title"]))))

    return tx.let(F.array_sort(places, lambda a, b: a["at"] - b["at"]), of)


def guidance_chunks(docs: DataFrame) -> DataFrame:
    """Adds `_chunks` to guidance: by table of contents (`toc`, an array of titles, if there is one), else by numbered headings."""
    text = F.col("full_text")

    def of(cut: Column) -> Column:
        first = F.get(cut, F.lit(0))

        def lead(pre: Column) -> Column:
            plain = F.array(_chunk(pre, _null(), _null(), _null(), F.lit("Preamble")))
            return F.when(pre.isNotNull() & (tx.estimate_tokens(pre) > LEAST_TOKENS), plain).otherwise(F.slice(plain, 1, 0))

        def headed(spans: Column) -> Column:
            each = F.flatten(F.transform(spans, lambda p: tx.let(tx.strip(p), lambda t: section_chunks(t, label_of(p, tx.HEADING)))))
            none = _windows(text, _null(), _null(), _null(), _null())
            return F.when(F.size(spans) == 0, none).otherwise(F.concat(tx.let(F.when(label_of(first, tx.HEADING).isNull(), tx.strip(first)), lead), each))

        return tx.let(F.filter(cut, lambda p: label_of(p, tx.HEADING).isNotNull()), headed)

    chunks = tx.let(parts(text, tx.HEADING), of)
    if "toc" in docs.columns:
        chunks = F.when(F.size("toc") > 0, toc_chunks(text, F.col("toc"))).otherwise(chunks)
    return docs.withColumn("_chunks", chunks)


def numbered_chunks(docs: DataFrame) -> DataFrame:
    """A row per element of `_chunks` with number, id, references and flags."""
    keep = [c for c in docs.columns if c not in ("_chunks", "full_text", "toc")]
    d = docs.select(*keep, F.posexplode_outer("_chunks").alias("chunk_index", "c")).where("chunk_index is not null").select(*keep, "chunk_index", "c.*")
    label = F.coalesce(F.nullif("article", F.lit("")), F.nullif("section", F.lit("")), F.when(F.col("paragraph").startswith("Recital"), F.col("paragraph")))
    return d.select(
        tx.chunk_id(F.col("source_id"), label, F.col("chunk_index")).alias("chunk_id"), "*", tx.cross_references(F.col("text"), F.col("article")).alias("cross_references"),
        tx.has_table(F.col("text")).alias("has_table"), tx.has_footnote(F.col("text")).alias("has_footnote"),
    )


def chunk_corpus(docs: DataFrame) -> DataFrame:
    """All chunks of documents (source_id, instrument_type, full_text, ...): statutes by articles, all else by sections."""
    statutes = statute_chunks(docs.where(F.col("instrument_type") == "statute"))
    others = guidance_chunks(docs.where(~F.col("instrument_type").eqNullSafe("statute")))
    return numbered_chunks(statutes).unionByName(numbered_chunks(others))
