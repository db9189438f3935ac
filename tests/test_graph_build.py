"""The full graph, its context nodes and the prompt made of it, on a small graph with known answers."""

import pytest
from pyspark.sql import functions as F

from regspark.operators import context as cx
from regspark.operators import graph as g
from regspark.sources import tables as src

ARTICLE = "source_id string, node_id string, article_label string, chapter string, section string, full_text string"


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame([("eu", "EU law", "statute"), ("ch", "Swiss law", "statute"), ("guide", "A guide", "guidance"), ("lone", "Alone", "guidance")], "source_id string, title string, instrument_type string")
    labels = [("eu", f"Article {n}") for n in range(1, 15)] + [("ch", "Art. 1"), ("ch", "Art. 5")]
    nodes = spark.createDataFrame([(s, f"{s}:{a}", a, "", "", "text " * 30) for s, a in labels], ARTICLE)
    chunks = spark.createDataFrame(
        [("eu", "Article 4", 3, "1. 'Data' means facts;"), ("eu", "Article 4", 7, "2. 'data' means later facts;;"), ("ch", "Art. 5", 1, "In this law:\na. a person means someone;\nb. use means any\nuse;")],
        "source_id string, article string, chunk_index int, text string",
    )
    defined = g.definitions(chunks, chunks["article"] == "Art. 5")
    said = '[{"description": " Keep records. ", "type": "Obligation", "subject": "controller"}, {"description": "", "type": "right"}, {"description": "Tell people", "type": "other"}]'
    answers = [("eu:Article 1", "eu", "Article 1", f"```json\n{said}\n```"), ("eu:Article 2", "eu", "Article 2", "[" + ", ".join(f'{{"description": "Duty {k} {"x" * 200}"}}' for k in range(7)) + "]"), ("none:Article 1", "none", "Article 1", said)]
    duties = g.obligations(spark.createDataFrame(answers, "article_node_id string, source_id string, article_label string, response string"))
    refers = [("eu:Article 1", f"eu:Article {n}", f"see {n}") for n in range(2, 15)] + [("eu:Article 2", "eu:Article 1", "b"), ("eu:Article 2", "eu:Article 1", "a"), ("eu:Article 2", "eu:Article 99", "gone")]
    all_nodes = src.stored(g.node_table(docs, nodes, defined, duties), "nodes")
    edges = g.edge_table(all_nodes, {
        "CONTAINS": g.contains(nodes), "REFERENCES": spark.createDataFrame(refers, "src string, dst string, reference_text string"),
        "CITES": spark.createDataFrame([("guide", "eu:Article 1"), ("lone", "eu:Article 1"), ("guide", "eu:Article 3")], "src string, dst string"),
        "EQUIVALENT_TO": spark.createDataFrame([("ch:Art. 1", "eu:Article 1", "same")], "src string, dst string, note string"),
        "DEFINES": g.defines(defined), "IMPOSES": g.imposes(duties),
    })
    return all_nodes, src.stored(edges, "edges")


def test_ten_counts(spark, built):
    assert g.stats(*built).first().asDict() == {
        "instruments": 4, "articles": 16, "definitions": 3, "obligations": 11, "contains": 16, "references": 14, "defines": 3, "imposes": 9, "cites": 3, "equivalent_to": 1,
    }
    empty = [df.limit(0) for df in built]
    assert set(g.stats(*empty).first()) == {0}


def test_last_definition_and_first_property_win(built):
    nodes, edges = built
    assert nodes.where("node_id = 'eu:def:data'").first().definition_text == "later facts"
    assert nodes.where("node_id = 'ch:def:use'").first().definition_text == "any\nuse"
    assert [r.property for r in edges.where("src = 'eu:Article 2' and dst = 'eu:Article 1'").collect()] == ["a"]


def test_context_nodes_begin_with_the_article(spark, built):
    nodes, edges = built
    seeds = spark.createDataFrame([("eu:Article 1",), ("unknown",)], "node_id string")
    rows = g.context_nodes(seeds, edges, nodes).orderBy("place", "node_id").collect()
    assert {r.seed for r in rows} == {"eu:Article 1"} and (rows[0].node_id, rows[0].role) == ("eu:Article 1", "article")
    roles = [r.role for r in rows]
    assert [roles.count(x) for x in ("article", "instrument", "definition", "refers_to", "referred_by", "obligation", "equivalent")] == [1, 1, 0, 13, 1, 2, 1]


def prompt_of(spark, built, hits, seeds, asked=("q", "empty")):
    nodes, edges = built
    h = spark.createDataFrame(hits, "query_id string, rank int, source_id string, article string, section string, instrument_type string, text string")
    s = spark.createDataFrame(seeds, "query_id string, place int, ref string")
    q = spark.createDataFrame([(x,) for x in asked], "query_id string")
    return {r.query_id: r for r in cx.context_prompt(q, h, cx.graph_items(s, edges, nodes)).collect()}


def test_prompt_has_all_sections_in_order(spark, built):
    hits = [("q", 2, "guide", None, "2", "guidance", "second"), ("q", 1, "eu", "Article 1", "", "statute", "first")]
    got = prompt_of(spark, built, hits, [("q", 1, "eu:Article 1"), ("q", 2, "nowhere:Article 1"), ("q", 3, "eu:Article 4")])
    ids = sorted(r.node_id for r in built[0].where("kind = 'Obligation' and source_id = 'eu' and (description like 'Keep%' or description like 'Tell%')").collect())
    said = {r.node_id: f"    [{r.obligation_type}] {r.description}" for r in built[0].where("kind = 'Obligation'").collect()}
    refs = sorted(f"eu:Article {n}" for n in range(2, 15))[:10]
    assert got["q"].prompt == "\n".join([
        " Retrieved Passages ", "[Passage 1] Source: EU | Location: Article 1 | Type: statute\nfirst", "[Passage 2] Source: GUIDE | Location: 2 | Type: guidance\nsecond", "\n Knowledge Graph Context ",
        "\n[Article: eu:Article 1]", " Obligations (2):", *(said[i] for i in ids), " Cross-references: " + ", ".join(refs),
        "\n[Cross-jurisdictional equivalent: eu:Article 1 ↔ ch:Art. 1]", "\n[Guidance citing eu:Article 1]: A guide, Alone",
        "\n[Article: eu:Article 4]", " Definition: 'data' — later facts", " Cross-references: eu:Article 4",
    ])
    assert (got["q"].n_passages, got["q"].n_items) == (2, 4)


def test_obligations_are_capped_and_cut(spark, built):
    text = prompt_of(spark, built, [], [("q", 1, "eu:Article 2")])["q"].prompt
    assert text.startswith("\n Knowledge Graph Context \n\n[Article: eu:Article 2]\n Obligations (7):\n") and text.count("    [") == 5
    assert all(len(line) <= len("    [obligation] ") + 150 for line in text.split("\n") if line.startswith("    ["))


def test_empty_context_is_an_empty_text(spark, built):
    got = prompt_of(spark, built, [], [("q", 1, "nowhere:Article 1")])
    assert got["empty"].prompt == "" == got["q"].prompt
    d = spark.createDataFrame([("", "fine answer"), (" \n", "fine"), ("context", "It cannot determine that."), ("context", "Article 6 says so."), (None, None)], "p string, a string")
    assert [r.c for r in d.select(cx.confidence(d["p"], d["a"]).alias("c")).collect()] == ["insufficient_evidence"] * 3 + ["sufficient", "insufficient_evidence"]


def test_hops_end_and_stay_linear(spark):
    """A ring of five with a tail: all its edges in five hops, each once, and a plan of as many joins as rounds."""
    edges = spark.createDataFrame([(f"n{k}", f"n{(k + 1) % 5}") for k in range(5)] + [("n0", "t1"), ("t1", "t2")], "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("t1",), ("t2",), ("x",)], "node_id string")
    for depth in range(1, 6):
        got = sorted((r.seed, r.src, r.dst) for r in g.k_hops(seeds, edges, depth).collect())
        want = set()
        for s in ("n0", "t1", "t2", "x"):
            reached = {s}
            for _ in range(depth):
                step = {(s, r.src, r.dst) for r in edges.collect() if r.src in reached}
                want |= step
                reached |= {d for _, _, d in step}
        assert got == sorted(want)
    plan = g.k_hops(seeds, edges, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0


def test_a_table_is_made_once_for_a_version(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/t").selectExpr("id + 1 AS x")

    spark.range(3).write.parquet(f"{tmp_path}/t")
    of = src.version(spark, f"{tmp_path}/t")
    for _ in range(2):
        assert src.stored_once(spark, "plus", of, build).agg({"x": "sum"}).first()[0] == 6
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t")
    new = src.version(spark, f"{tmp_path}/t")
    assert new != of and src.stored_once(spark, "plus", new, build).count() == 5 and len(made) == 2


def test_repeated_duties_of_one_response_are_one(spark):
    """The last of equal beginnings counts, and a node table may take such ids as unique without moving rows."""
    said = '[{"description": "%s first"}, {"description": "other"}, {"description": " %s last", "type": "right"}]' % ("x" * 50, "x" * 50)
    rows = spark.createDataFrame([("eu:Article 1", "eu", "Article 1", f" \n```json\n{said}\n``` \n"), ("eu:Article 2", "eu", "Article 2", said + "\n```")], "article_node_id string, source_id string, article_label string, response string")
    duties = g.obligations(rows)
    assert sorted((r.article_label, r.description[50:], r.obligation_type) for r in duties.collect()) == [(a, d, t) for a in ("Article 1", "Article 2") for d, t in (("", "obligation"), (" last", "right"))]
    docs = spark.createDataFrame([("eu", "EU law")], "source_id string, title string")
    nodes = spark.createDataFrame([], ARTICLE)
    none = g.definitions(spark.createDataFrame([], "source_id string, article string, chunk_index int, text string"), F.lit(True))
    both = [g.node_table(docs, nodes, none, duties, u).where("kind = 'Obligation'") for u in ((), ("Obligation",))]
    assert sorted(both[0].collect()) == sorted(both[1].collect()) and both[0].count() == 4
    assert "max_by" in both[0]._jdf.queryExecution().executedPlan().toString()
    moved = [d._jdf.queryExecution().executedPlan().toString().count("Exchange") for d in both]
    assert moved[1] < moved[0]


def test_edges_are_built_without_what_nodes_say(spark):
    from regspark.plans.graph_queries import Graph

    graph = Graph(spark, "/root/testdata/sf0.001")
    assert sorted(r[0] for r in graph.node_ids.distinct().collect()) == sorted(r[0] for r in graph.nodes.select("node_id").distinct().collect())
    assert graph.node_ids.columns == ["node_id"]
