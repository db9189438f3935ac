"""The property graph: node and edge tables from chunks, and queries on them as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import stored

ARTICLE_CHARS, DEFINITION_CHARS, OBLIGATION_CHARS, DESCRIPTION_KEY = 2000, 500, 300, 50
OBLIGATION_TYPES = ("obligation", "right", "prohibition", "permission")


def articles(chunks: DataFrame) -> DataFrame:
    """One node per (source, article): texts joined in chunk order, chapter and section of the first chunk, then cut."""
    own = chunks.where(F.coalesce("article", F.lit("")) != "")
    order = F.struct("chunk_index", "text")
    d = own.groupBy("source_id", F.col("article").alias("article_label")).agg(
        F.array_sort(F.collect_list(order)).alias("t"), F.min_by(F.coalesce("chapter", F.lit("")), "chunk_index").alias("chapter"), F.min_by(F.coalesce("section", F.lit("")), "chunk_index").alias("section")
    )
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return d.select(F.concat_ws(":", "source_id", "article_label").alias("node_id"), "source_id", "article_label", "chapter", "section", tx.truncated(text, ARTICLE_CHARS).alias("full_text"))


def resolved(refs: DataFrame, nodes: DataFrame, statutes: DataFrame) -> DataFrame:
    """Adds `target` to rows with `source_id` and `ref`: the article of that number in the primary statute, else in the fallback.

    `statutes` has (source_id, primary_statute, fallback_statute).  Rows that meet neither are dropped.
    """
    numbered = nodes.select(F.col("source_id").alias("_s"), tx.article_number(F.col("article_label")).alias("_n"), F.col("node_id").alias("_t"))
    numbered = numbered.groupBy("_s", "_n").agg(F.min("_t").alias("_t"))
    d = refs.withColumn("_num", tx.article_number(F.col("ref"))).where("_num is not null").join(statutes, "source_id")
    choices = d.withColumn("_c", F.explode_outer(F.array(F.struct(F.lit(0).alias("rank"), F.col("primary_statute").alias("s")), F.struct(F.lit(1).alias("rank"), F.col("fallback_statute").alias("s")))))
    met = choices.join(numbered, (F.col("_c.s") == F.col("_s")) & (F.col("_num") == F.col("_n")))
    return met.groupBy(*refs.columns).agg(F.min_by("_t", "_c.rank").alias("target"))


def references(chunks: DataFrame, nodes: DataFrame, statutes: DataFrame) -> DataFrame:
    """REFERENCES edges (src, dst, reference_text): self edges dropped, the first mention of a pair kept."""
    rows = chunks.where("article is not null").select("source_id", F.concat_ws(":", "source_id", "article").alias("src"), "chunk_index", F.explode_outer("cross_references").alias("ref")).where("ref is not null")
    met = resolved(rows, nodes, statutes).where("target <> src")
    return met.groupBy("src", F.col("target").alias("dst")).agg(F.min_by("ref", F.struct("chunk_index", "ref")).alias("reference_text"))


def cites(chunks: DataFrame, nodes: DataFrame, statutes: DataFrame) -> DataFrame:
    """CITES edges (src instrument, dst article), distinct."""
    rows = chunks.where("instrument_type = 'guidance'").select("source_id", F.explode_outer("cross_references").alias("ref")).where("ref is not null").distinct()
    return resolved(rows, nodes, statutes).select(F.col("source_id").alias("src"), F.col("target").alias("dst")).distinct()


def contains(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("source_id").alias("src"), F.col("node_id").alias("dst"))


def equivalents(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Curated pairs (left_id, right_id, note) of which both ends exist."""
    left = pairs.join(nodes.select(F.col("node_id").alias("left_id")), "left_id", "left_semi")
    return left.join(nodes.select(F.col("node_id").alias("right_id")), "right_id", "left_semi").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), "note")


def definitions(chunks: DataFrame, listed: Column, kept: tuple[str, ...] = ()) -> DataFrame:
    """Definitions of chunks: one per chunk (n. 'term' means ...), or, where `listed`, one per lettered item (term means ...).

    Columns of the chunks that are in `kept` go along.
    """
    quoted = r"(?s)^\d+\.\s+['‘’]([^'‘’]+)['‘’]\s+means\s+(.+)"
    item = r"(?s)^(.+?)\s+means\s+(.+)"
    lettered = F.filter(F.split("text", r"\n(?=[a-k]\.\s)"), lambda p: p.rlike(r"^[a-k]\.\s"))
    lettered = F.transform(lettered, lambda p: tx.strip(F.regexp_replace(p, r"^[a-k]\.\s+", "")))
    index = F.col("chunk_index") if "chunk_index" in chunks.columns else F.lit(0)
    rows = chunks.select("*", F.posexplode_outer(F.when(listed, lettered).otherwise(F.array("text"))).alias("_k", "_i")).withColumn("place", F.struct(index.alias("chunk"), F.col("_k").alias("item")))
    pattern = lambda g: F.when(listed, F.regexp_extract("_i", item, g)).otherwise(F.regexp_extract("_i", quoted, g))
    rows = rows.withColumn("term", tx.strip(pattern(1))).withColumn("definition_text", F.regexp_replace(tx.strip(pattern(2)), r";+\z", "")).where("term <> ''")
    return rows.select(
        F.concat(F.col("source_id"), F.lit(":def:"), F.lower("term")).alias("node_id"), "term", F.substring("definition_text", 1, DEFINITION_CHARS).alias("definition_text"), "source_id", F.col("article").alias("article_label"), "place",
        *kept,
    )


def obligations(responses: DataFrame) -> DataFrame:
    """Obligations of model responses (article_node_id, source_id, article_label, response): a JSON array, fenced or not; all else gives none.

    The id is made of the article and the description's beginning; of equal ones in a response the last is kept.
    """
    said = tx.strip(F.col("response"))
    body = tx.let(said, lambda r: F.when(F.startswith(r, F.lit("```")), F.regexp_replace(F.regexp_replace(r, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(F.when(F.endswith(r, F.lit("```")), F.regexp_replace(r, r"\s*```$", "")).otherwise(r)))
    items = tx.let(body, lambda b: F.when(F.startswith(b, F.lit("[")), F.from_json(b, "array<struct<description:string,type:string,subject:string>>")))

    def last_of_equals(all_: Column) -> Column:
        begins = F.transform(all_, lambda o: F.substring(tx.strip(F.coalesce(o["description"], F.lit(""))), 1, DESCRIPTION_KEY))
        return tx.let(begins, lambda b: F.transform(all_, lambda o, i: F.when(~F.array_contains(F.slice(b, i + 2, F.size(b)), F.get(b, i)), o)))

    d = responses.select("article_node_id", "source_id", "article_label", F.posexplode_outer(tx.let(items, last_of_equals)).alias("place", "_o")).where("_o is not null")
    kind = F.lower(tx.strip(F.coalesce("_o.type", F.lit("obligation"))))
    description = tx.strip(F.coalesce("_o.description", F.lit("")))
    d = d.select("article_node_id", "source_id", "article_label", description.alias("d"), F.when(kind.isin(*OBLIGATION_TYPES), kind).otherwise("obligation").alias("obligation_type"), tx.strip(F.coalesce("_o.subject", F.lit(""))).alias("subject"), "place")
    node = tx.short_hash("source_id", "article_label", F.substring("d", 1, DESCRIPTION_KEY))
    return d.where("d <> ''").select(node.alias("node_id"), F.substring("d", 1, OBLIGATION_CHARS).alias("description"), "obligation_type", "source_id", "article_label", "subject", "article_node_id", "place")


def obligation_candidates(nodes: DataFrame, statutes: list[str] | Column, skipped: tuple[str, ...] = ("Article 4", "Art. 5"), least: int = 100) -> DataFrame:
    wanted = F.col("source_id").isin(statutes) if isinstance(statutes, list) else statutes
    return nodes.where(wanted & ~F.col("article_label").isin(*skipped) & (F.length("full_text") >= least))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose ends both exist, the first of each (src, dst, type)."""
    ids = nodes.select("node_id").distinct()
    met = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return met.dropDuplicates(["src", "dst", "type"])


NODE = ("node_id", "kind", "source_id", "label", "title", "chapter", "section", "full_text", "term", "definition_text", "description", "obligation_type", "subject")
NODE_KINDS = {"Instrument": "instruments", "Article": "articles", "Definition": "definitions", "Obligation": "obligations"}
EDGE_KINDS = {"CONTAINS": "contains", "REFERENCES": "references", "DEFINES": "defines", "IMPOSES": "imposes", "CITES": "cites", "EQUIVALENT_TO": "equivalent_to"}


def node_table(instruments: DataFrame, nodes: DataFrame, defined: DataFrame, imposed: DataFrame, unique: tuple[str, ...] = ()) -> DataFrame:
    """All nodes in one table of NODE columns; of equal ids of a kind the last (by `place`, where there is one) is kept.

    An instrument's text is that of its articles, so it has none of its own here.  Kinds in `unique` have no equal ids, and their rows are not moved.
    """
    parts = []
    for kind, df, label in (
        ("Instrument", instruments.withColumn("node_id", F.col("source_id")).drop("full_text"), F.col("title")), ("Article", nodes, F.col("article_label")), ("Definition", defined, F.col("term")),
        ("Obligation", imposed, tx.truncated(F.col("description"), 40)),
    ):
        d = df.withColumn("kind", F.lit(kind)).withColumn("label", label)
        columns = [F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in NODE]
        if "place" in df.columns and kind not in unique:
            last = d.groupBy("node_id").agg(F.max_by(F.struct(*(c for c in NODE if c in d.columns)), F.struct("place", "label")).alias("n"))
            d = last.select("n.*")
        parts.append(d.select(columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edge_table(nodes: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """All edges (src, dst, type, property) whose ends are among the nodes (node_id), one of each (src, dst, type).

    `kinds` has a table (src, dst and at most one property) for each type; of repeated edges the least property is kept.
    """
    out = None
    for kind, df in kinds.items():
        more = [c for c in df.columns if c not in ("src", "dst")]
        rows = df.select("src", "dst", F.lit(kind).alias("type"), (F.col(more[0]).cast("string") if more else F.lit(None).cast("string")).alias("property"))
        out = rows if out is None else out.unionByName(rows)
    ids = nodes.select("node_id").distinct()
    met = out.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return met.groupBy("src", "dst", "type").agg(F.min("property").alias("property"))


def defines(defined: DataFrame) -> DataFrame:
    return defined.select(F.concat_ws(":", "source_id", "article_label").alias("src"), F.col("node_id").alias("dst"))


def imposes(imposed: DataFrame) -> DataFrame:
    return imposed.select(F.col("article_node_id").alias("src"), F.col("node_id").alias("dst"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the count of each kind of node and edge, zero where there is none."""
    kinds = nodes.groupBy(F.col("kind").alias("k")).count().unionByName(edges.groupBy(F.col("type").alias("k")).count())
    return kinds.agg(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("count"))), F.lit(0).cast("long")).alias(name) for k, name in {**NODE_KINDS, **EDGE_KINDS}.items()))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def context_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, type, from, to) of the relations around each seed node; equivalents go outward.

    One pass over an edge table in both orientations instead of one join per relation.
    """
    out = edges.where("type in ('DEFINES', 'REFERENCES', 'IMPOSES', 'EQUIVALENT_TO')").select(F.col("src").alias("seed"), "type", F.col("src").alias("from"), F.col("dst").alias("to"))
    into = edges.where("type in ('CONTAINS', 'REFERENCES')").select(F.col("dst").alias("seed"), "type", F.col("src").alias("from"), F.col("dst").alias("to"))
    back = edges.where("type = 'EQUIVALENT_TO'").select(F.col("dst").alias("seed"), "type", F.col("dst").alias("from"), F.col("src").alias("to"))
    return out.unionByName(into).unionByName(back).join(seeds.select(F.col("node_id").alias("seed")), "seed", "left_semi").distinct()


def k_hops(seeds: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(seed, src, dst): the edges on any directed path of at most `depth` (1 to 5) steps from each seed.

    Each round follows only what the last one reached first, and is stored, so
    its plan has the joins of one round; it ends where nothing new is reached.
    """
    steps = edges.select("src", "dst").distinct()
    frontier = stored(seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("src")).distinct(), "frontier")
    seen, found = frontier, []
    for step in range(max(1, min(depth, 5))):
        if step:
            reached = found[-1].select("seed", F.col("dst").alias("src")).distinct()
            frontier = stored(reached.join(seen, ["seed", "src"], "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        # a node is followed once for a seed, so no edge is found twice
        found.append(stored(frontier.join(steps, "src").select("seed", "src", "dst"), "reached"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def context_nodes(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, place, role, node columns): the nodes of each seed's context, the article itself first (place 0), each once per role.

    Roles in order: article, instrument, definition, refers_to, referred_by, obligation, equivalent. Seeds without a node give no row.
    """
    own = seeds.select(F.col("node_id").alias("seed")).distinct()
    around = context_edges(seeds, edges)
    other = F.when(F.col("from") == F.col("seed"), F.col("to")).otherwise(F.col("from"))
    role = (
        F.when(F.col("type") == "CONTAINS", 1).when(F.col("type") == "DEFINES", 2).when((F.col("type") == "REFERENCES") & (F.col("from") == F.col("seed")), 3)
        .when(F.col("type") == "REFERENCES", 4).when(F.col("type") == "IMPOSES", 5).otherwise(6)
    )
    rows = own.select("seed", F.lit(0).alias("place"), F.col("seed").alias("node_id")).unionByName(around.select("seed", role.alias("place"), other.alias("node_id"))).distinct()
    roles = F.array(*map(F.lit, ("article", "instrument", "definition", "refers_to", "referred_by", "obligation", "equivalent")))
    return rows.join(nodes, "node_id").withColumn("role", F.get(roles, F.col("place")))


def subgraph_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, from, to) around a set of seeds: references both ways, definitions, equivalents, containing instruments."""
    kinds = edges.where("type in ('DEFINES', 'REFERENCES', 'CONTAINS', 'EQUIVALENT_TO')")
    around = context_edges(seeds, kinds)
    return around.select("type", "from", "to").distinct()


def expanded(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, kind, ref, type, from, to) for seeds (query_id, ref): own context, that of each equivalent, citing guidance."""
    known = seeds.join(nodes.select(F.col("node_id").alias("ref")), "ref", "left_semi").select("query_id", "ref").distinct()
    around = context_edges(known.select(F.col("ref").alias("node_id")).distinct(), edges)
    own = known.join(around, known["ref"] == around["seed"]).select("query_id", F.lit("article_context").alias("kind"), "ref", "type", "from", "to")
    twins = both_ways(edges.where("type = 'EQUIVALENT_TO'"))
    paired = known.join(twins, known["ref"] == twins["src"]).select("query_id", F.col("dst").alias("ref")).distinct()
    far = context_edges(paired.select(F.col("ref").alias("node_id")).distinct(), edges)
    other = paired.join(far, paired["ref"] == far["seed"]).select("query_id", F.lit("equivalent_article").alias("kind"), "ref", "type", "from", "to")
    citing = edges.where("type = 'CITES'")
    guidance = known.join(citing, known["ref"] == citing["dst"]).select("query_id", F.lit("guidance_citations").alias("kind"), "ref", F.lit("CITES").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"))
    return own.unionByName(other).unionByName(guidance).distinct()


def matching_terms(terms: DataFrame, fragment: str) -> DataFrame:
    """Definitions whose term has the fragment, whatever the case, by term."""
    return terms.where(F.contains(F.lower("term"), F.lower(F.lit(fragment)))).orderBy("term", "source_id")


def listed_terms(terms: DataFrame, source: str | None = None) -> DataFrame:
    """All definitions by source and term, or those of one source by term."""
    return terms.orderBy("source_id", "term") if source is None else terms.where(F.col("source_id") == source).orderBy("term")


def labelled_nodes(nodes: DataFrame) -> DataFrame:
    """Adds `kind` and `label` from the properties that a node has: article, term, description, title, else its id."""
    has = lambda c: F.col(c).isNotNull() if c in nodes.columns else F.lit(False)
    value = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    kind = F.when(has("article_label"), "Article").when(has("term"), "Definition").when(has("description"), "Obligation").when(has("title"), "Instrument").otherwise("Node")
    label = F.coalesce(value("article_label"), value("term"), tx.truncated(value("description"), 40), value("title"), F.col("node_id"))
    return nodes.withColumn("kind", kind).withColumn("label", label)


def view_nodes(context: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids of the nodes of a context, and of hits that it does not have yet."""
    around = context.select(F.col("from").alias("node_id")).unionByName(context.select(F.col("to").alias("node_id"))).distinct()
    return around.unionByName(hits.select("node_id").distinct().join(around, "node_id", "left_anti"))
