"""Prompt context: passages and graph sections as text, one row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def ordered_lines(df: DataFrame, key: str, order: list[str], line: Column, separator: str, name: str) -> DataFrame:
    """The lines of each key in order, joined; at most a question's own hits meet in one row."""
    rows = df.select(key, F.struct(*order, line.alias("_line")).alias("_r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_line"]), separator).alias(name))


def passage(source: Column, article: Column, section: Column, kind: Column, rank: Column, text: Column) -> Column:
    place = F.array_join(F.filter(F.array(article, section), lambda x: x.isNotNull() & (x != "")), " > ")
    return F.concat(F.lit("[Passage "), rank.cast("string"), F.lit("] Source: "), F.upper(source), F.lit(" | Location: "), place, F.lit(" | Type: "), kind, F.lit("\n"), text)


def benchmark_passage(source: Column, parts: list[Column], rank: Column, text: Column, most: int = 800) -> Column:
    place = F.coalesce(F.nullif(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", "), F.lit("")), F.lit("General"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] Source: "), tx.named(F.upper(source), tx.SOURCES), F.lit(", "), place, F.lit('\n"'), tx.truncated(tx.strip(text), most), F.lit('"'))


def benchmark_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context passages:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question)


def evidence(hits: DataFrame) -> DataFrame:
    """Display rows of hits: upper-case source, place, three decimals, a preview of one line."""
    return hits.select("query_id", "rank", F.upper("source_id").alias("source"), tx.location(F.col("article"), F.col("section")).alias("location"), F.format_number("score", 3).alias("score"), tx.preview(F.col("text"), 300).alias("preview"))


#: How much of an article's context is shown: obligations and references, and characters of definitions and of obligations.
IN_PROMPT, IN_EVIDENCE = {"obligations": 5, "references": 10, "definition": 200, "obligation": 150}, {"obligations": 5, "references": 8, "definition": 120, "obligation": 120}


def article_parts(refs: DataFrame, edges: DataFrame, nodes: DataFrame, limits: dict[str, int] = IN_PROMPT) -> DataFrame:
    """(ref, definitions, n_obligations, obligations, n_references, references) of the articles `refs` (ref) that exist.

    Definitions are all there, by id; obligations and references are the first that `limits` allow: obligations by id, references
    as the ends of their edges, outgoing ones by id, then incoming ones.  Texts are as long as `limits` say.  All limits hold before rows are moved
    (a limit inside the window, per article and kind), so an article that all others refer to stays small.
    """
    known = refs.select("ref").distinct().join(nodes.where("kind = 'Article'").select(F.col("node_id").alias("ref")), "ref", "left_semi")
    out = edges.where("type in ('DEFINES', 'IMPOSES', 'REFERENCES')").select(F.col("src").alias("ref"), "type", F.lit(0).alias("way"), F.col("dst").alias("other"), F.col("dst").alias("end"))
    into = edges.where("type = 'REFERENCES'").select(F.col("dst").alias("ref"), "type", F.lit(1).alias("way"), F.col("src").alias("other"), F.col("dst").alias("end"))
    around = out.unionByName(into).join(known, "ref", "left_semi")
    counts = around.groupBy("ref").agg(F.count_if(F.col("type") == "IMPOSES").alias("n_obligations"), F.count_if(F.col("type") == "REFERENCES").alias("n_references"))
    order = Window.partitionBy("ref", "type").orderBy("way", "other")
    most = max(limits["obligations"], limits["references"])
    few = around.where("type <> 'DEFINES'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    few = few.where(F.col("_r") <= F.when(F.col("type") == "IMPOSES", limits["obligations"]).otherwise(limits["references"])).drop("_r")
    # a reference is shown by its ends, which exist, so only what says something is looked up
    texts = nodes.where("kind in ('Definition', 'Obligation')").select(
        F.col("node_id").alias("other"), "term", F.substring("definition_text", 1, limits["definition"]).alias("definition_text"), F.substring("description", 1, limits["obligation"]).alias("description"), "obligation_type"
    )
    told = few.where("type = 'IMPOSES'").unionByName(around.where("type = 'DEFINES'")).join(texts, "other")
    shown = told.unionByName(few.where("type = 'REFERENCES'"), allowMissingColumns=True)
    of = lambda kind, *c: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(*c))))
    lists = shown.groupBy("ref").agg(
        of("DEFINES", "other", "term", "definition_text").alias("definitions"), of("IMPOSES", "other", "obligation_type", "description").alias("obligations"),
        F.transform(of("REFERENCES", "way", "other", "end"), lambda x: x["end"]).alias("references"),
    )
    d = known.join(counts, "ref", "left").join(lists, "ref", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return d.select("ref", "definitions", zero("n_obligations"), "obligations", zero("n_references"), "references")


def article_section(limits: dict[str, int] = IN_PROMPT) -> Column:
    """The section of an article in a prompt, from the columns of `article_parts`; parts that are empty leave no line."""
    none = F.array().cast("array<string>")
    defined = F.transform(
        F.filter("definitions", lambda x: F.coalesce(x["term"], F.lit("")) != ""),
        lambda x: F.concat(F.lit(" Definition: '"), x["term"], F.lit("' — "), F.substring(x["definition_text"], 1, limits["definition"])),
    )
    imposed = F.transform(
        F.slice("obligations", 1, limits["obligations"]),
        lambda x: F.concat(F.lit("    ["), F.coalesce(x["obligation_type"], F.lit("?")), F.lit("] "), F.substring(F.coalesce(x["description"], F.lit("")), 1, limits["obligation"])),
    )
    title = F.array(F.concat(F.lit(" Obligations ("), F.col("n_obligations").cast("string"), F.lit("):")))
    refers = F.array(F.concat(F.lit(" Cross-references: "), F.array_join(F.slice("references", 1, limits["references"]), ", ")))
    lines = F.concat(
        F.array(F.concat(F.lit("\n[Article: "), F.col("ref"), F.lit("]"))), F.coalesce(defined, none),
        F.when(F.col("n_obligations") > 0, F.concat(title, imposed)).otherwise(none), F.when(F.col("n_references") > 0, refers).otherwise(none),
    )
    return F.array_join(lines, "\n")


def graph_items(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, place, kind, other, ref, text) of what the graph has on the seeds (query_id, place, ref), as sections of a prompt.

    Kinds: 0 the article's own context, 1 its equivalents (one item each, `other`), 2 the guidance that cites it.
    A seed without a node, or without any of these, gives no item.  Each article's text is made once, whoever asks for it.
    """
    asked = seeds.select("ref").distinct()
    own = article_parts(asked, edges, nodes, IN_PROMPT).select("ref", F.lit(0).alias("kind"), F.lit("").alias("other"), article_section().alias("text"))
    equal = edges.where("type = 'EQUIVALENT_TO'")
    twins = equal.select(F.col("src").alias("ref"), F.col("dst").alias("other")).unionByName(equal.select(F.col("dst").alias("ref"), F.col("src").alias("other"))).distinct()
    named = F.concat(F.lit("\n[Cross-jurisdictional equivalent: "), "ref", F.lit(" ↔ "), "other", F.lit("]"))
    twins = twins.join(asked, "ref", "left_semi").select("ref", F.lit(1).alias("kind"), "other", named.alias("text"))
    citing = edges.where("type = 'CITES'").select(F.col("dst").alias("ref"), F.col("src").alias("node_id")).join(asked, "ref", "left_semi").join(nodes.where("kind = 'Instrument'").select("node_id", "title"), "node_id")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.coalesce("title", "node_id").alias("title")))), lambda x: x["title"])
    citing = citing.groupBy("ref").agg(F.array_join(titles, ", ").alias("titles"))
    citing = citing.select("ref", F.lit(2).alias("kind"), F.lit("").alias("other"), F.concat(F.lit("\n[Guidance citing "), "ref", F.lit("]: "), "titles").alias("text"))
    return seeds.select("query_id", "place", "ref").join(own.unionByName(twins).unionByName(citing), "ref").select("query_id", "place", "kind", "other", "ref", "text")


def context_prompt(queries: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, prompt, n_passages, n_items) for every query: its passages by rank, then its graph items; "" if it has neither."""
    line = passage(F.col("source_id"), F.col("article"), F.col("section"), F.col("instrument_type"), F.col("rank"), F.col("text"))
    rows = hits.select("query_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    passages = rows.select("query_id", F.size("r").cast("long").alias("n_passages"), F.concat(F.lit(" Retrieved Passages \n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("passages"))
    own = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "other", "text"))).alias("i"))
    own = own.select("query_id", F.size("i").cast("long").alias("n_items"), F.concat(F.lit("\n Knowledge Graph Context \n"), F.array_join(F.transform("i", lambda x: x["text"]), "\n")).alias("graph"))
    d = queries.select("query_id").distinct().join(passages, "query_id", "left").join(own, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return d.select("query_id", F.concat_ws("\n", "passages", "graph").alias("prompt"), zero("n_passages"), zero("n_items"))


def user_prompt(prompt: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), prompt, F.lit("\n\nQuestion: "), question)


def confidence(prompt: Column, answer: Column) -> Column:
    """What is said of an answer: insufficient where the context was blank or the answer admits it."""
    return F.when((tx.strip(F.coalesce(prompt, F.lit(""))) == "") | tx.says_any(F.coalesce(answer, F.lit(""))), "insufficient_evidence").otherwise("sufficient")
