"""Graph, search, interpretation and evaluation on small tables; sources, upserts and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from regspark.functions import scores as sc
from regspark.operators import evaluate as ev
from regspark.operators import graph as g
from regspark.operators import interpret as it
from regspark.operators import search as se
from regspark.operators import tables as tb
from regspark.sources import tables as src
from regspark.streaming.ingest import chunk_stream, chunk_table

EDGES = "src string, dst string, type string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "REFERENCES"), ("b", "c", "REFERENCES"), ("c", "a", "REFERENCES"), ("c", "d", "REFERENCES"), ("i", "a", "CONTAINS"), ("a", "z", "EQUIVALENT_TO"), ("y", "a", "CITES"), ("a", "t", "DEFINES")]
    return spark.createDataFrame(rows, EDGES)


def node(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_k_hops_are_the_edges_within_reach(spark, edges):
    hops = lambda d: sorted((r.src, r.dst) for r in g.k_hops(node(spark, "a"), edges.where("type = 'REFERENCES'"), d).collect())
    assert hops(1) == [("a", "b")] == hops(0) and hops(2) == [("a", "b"), ("b", "c")] and hops(3) == hops(9) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert g.k_hops(node(spark, "nowhere"), edges, 2).count() == 0


def test_context_goes_both_ways(spark, edges):
    got = {(r["type"], r["from"], r["to"]) for r in g.context_edges(node(spark, "a"), edges).collect()}
    assert got == {("REFERENCES", "a", "b"), ("REFERENCES", "c", "a"), ("CONTAINS", "i", "a"), ("EQUIVALENT_TO", "a", "z"), ("DEFINES", "a", "t")}
    assert ("EQUIVALENT_TO", "z", "a") in {(r["type"], r["from"], r["to"]) for r in g.context_edges(node(spark, "z"), edges).collect()}


def test_edges_need_both_ends(spark, edges):
    assert {(r.src, r.dst) for r in g.valid_edges(edges.unionByName(edges), node(spark, "a", "b", "c")).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}


def test_expansion_of_equivalents_and_guidance(spark, edges):
    seeds = spark.createDataFrame([("q", "a"), ("q", "missing")], "query_id string, ref string")
    kinds = {(r.kind, r.ref) for r in g.expanded(seeds, edges, node(spark, *"abcdz")).collect()}
    assert kinds == {("article_context", "a"), ("equivalent_article", "z"), ("guidance_citations", "a")}


def test_references_resolve_to_primary_then_fallback(spark):
    chunk = "source_id string, instrument_type string, chunk_index int, text string, article string, chapter string, section string, cross_references array<string>"
    rows = [("s", "statute", 0, "x", "Article 1", None, None, ["Article 2", "Art. 7", "Article 1(2)", "Article 99"]), ("s", "statute", 1, "y", "Article 2", None, None, []), ("f", "statute", 0, "z", "Art. 7", None, None, []), ("s", "statute", 2, "more", "Article 1", "C", None, ["Article 2"])]
    chunks = spark.createDataFrame(rows, chunk)
    nodes = g.articles(chunks)
    assert nodes.where("node_id = 's:Article 1'").first().full_text == "x\nmore"
    statutes = spark.createDataFrame([("s", "s", "f"), ("f", "f", "s")], "source_id string, primary_statute string, fallback_statute string")
    assert {(r.src, r.dst) for r in g.references(chunks, nodes, statutes).collect()} == {("s:Article 1", "s:Article 2"), ("s:Article 1", "f:Art. 7")}


def test_obligations_of_model_output(spark):
    item = {"description": "Keep records", "type": "Duty", "subject": "controller"}
    bodies = [json.dumps([item]), f"```json\n{json.dumps([item])}\n```", "not json", json.dumps(item), "[]", json.dumps([{"description": " ", "type": "right"}])]
    df = spark.createDataFrame([(f"n{i}", "s", "Article 1", b) for i, b in enumerate(bodies)], "article_node_id string, source_id string, article_label string, response string")
    got = g.obligations(df).collect()
    assert sorted(r.article_node_id for r in got) == ["n0", "n1"] and {r.obligation_type for r in got} == {"obligation"} and len({r.node_id for r in got}) == 1


@pytest.mark.parametrize(
    ("text", "refs"),
    [("What does GDPR Article 17 say?", ["gdpr:Article 17"]), ("Explain FADP Article 6", ["fadp:Art. 6"]), ("Article 49 of the GDPR", ["gdpr:Article 49"]), ("See Art. 6 GDPR", ["gdpr:Article 6"]), ("Art 25 FADP", ["fadp:Art. 25"]),
     ("Compare GDPR Article 17 and FADP Article 25", ["gdpr:Article 17", "fadp:Art. 25"]), ("GDPR Article 17 and Article 17 GDPR", ["gdpr:Article 17"]), ("gdpr article 5", ["gdpr:Article 5"]), ("What is data portability?", [])],
)
def test_article_references_of_questions(spark, text, refs):
    assert spark.range(1).select(it.article_refs(F.lit(text)).alias("r")).first().r == refs


def test_filters_are_substrings(spark):
    r = spark.range(1).select(it.keyword_filters(F.lit("A museum of the FDPIC"), it.JURISDICTIONS).alias("j"), it.keyword_filters(F.lit("edpb and FADP"), it.SOURCES).alias("s")).first()
    assert r.j == ["EU", "CH"] and r.s == ["fadp"]


def test_search_filters_before_ranking(spark):
    corpus = spark.createDataFrame([(i, [float(i == j) + 0.1 for j in range(4)], i % 2) for i in range(4)] + [(9, [0.0] * 4, 0)], "chunk_id long, vec array<float>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, query_vec array<float>")
    assert [r.chunk_id for r in se.top_k(q, corpus, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.chunk_id for r in se.top_k(q, corpus.where(se.any_of("label", [1])), 2).orderBy("rank").collect()] == [1, 3]
    assert se.top_k(q, corpus, 9).where("chunk_id = 9").first().similarity == 0.0


def test_lsh_finds_nine_of_ten(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    assert se.recall(se.top_k_lsh(q, c), se.top_k(q, c)) >= 0.9


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_word_distance(spark):
    pairs = [("a b c", "a c"), ("", ""), ("", "x y"), ("a", ""), ("a b a b", "b a b a"), ("one two three", "one too three four")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sc.word_distance(F.filter(F.split("a", " "), lambda x: x != ""), F.filter(F.split("b", " "), lambda x: x != "")).alias("d"))
    assert all(r.d == levenshtein(r.a.split(), r.b.split()) for r in df.collect())


def test_transcripts(spark):
    df = spark.createDataFrame([("What is GDPR Article 17?", "what is gdpr particle 17", ["GDPR", "Article 17"]), ("x", "y", [])], "ground_truth string, transcription string, entities array<string>")
    a, b = ev.transcript_scores(df).collect()
    assert a.wer == pytest.approx(0.2) and a.fabricated == 1 and a.entity_wer == 0.0 and (b.wer, b.entity_wer) == (1.0, 0.0)


def test_answers(spark):
    rows = [("By Article 17 and Art. 6.", ["Article 17"], True), ("I cannot determine that.", [], False), ("Article 1", [], True), ("none", ["Article 2"], True)]
    got = ev.answer_scores(spark.createDataFrame(rows, "response_text string, expected array<string>, evidence_sufficient boolean")).collect()
    assert [(r.citation_precision, r.citation_recall, r.calibration_correct) for r in got] == [(0.5, 1.0, True), (1.0, 1.0, True), (0.0, 1.0, True), (0.0, 0.0, True)]


def test_precision_divides_by_k(spark):
    df = spark.createDataFrame([("q", 1, False), ("q", 2, True)], "query_id string, rank int, relevant boolean")
    r = ev.retrieval_scores(df, ["query_id"]).first()
    assert (r.precision_at_5, r.precision_at_10, r.reciprocal_rank) == (0.2, 0.1, 0.5)


def test_tables_in_text(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | |\nend\n<table><tr><th>x</th></tr><tr><td>1</td><td> 2 </td></tr></table>"
    df = spark.createDataFrame([(1, text), (2, None), (3, "| only one line |")], "page int, text string")
    p, h = tb.pipe_tables(df).collect(), tb.html_tables(df).collect()
    assert [(r.page, r.rows) for r in p] == [(1, [["a", "b"], ["1", ""]])] and (h[0].row_count, h[0].col_count, h[0].rows) == (2, 2, [["x"], ["1", "2"]])
    assert df.where("page = 1").select(tb.without_tables(F.col("text")).alias("t")).first().t == "intro\n[TABLE]\nend\n[TABLE]"


def test_upserts(spark):
    schema = "k int, v string, o int"
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], schema)
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    once = src.upserted(old, new, ["k"], "o")
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")] == rows(src.upserted(once, new, ["k"], "o"))
    assert rows(src.upserted(old, new, ["k"], "o", insert_only=True)) == [(1, "a"), (2, "b"), (3, "e")]


def test_sources(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "chunks.json").write_text(json.dumps([{"chunk_id": "a", "text": "t", "source_id": "doc", "chunk_index": 0, "cross_references": ["Article 1"]}]))
    assert src.read_chunks(spark, f"{tmp_path}/*/chunks.json").first().cross_references == ["Article 1"]
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "law.json").write_text(json.dumps({"articles": [{"number": "1", "title": "x", "paragraph_count": 2}], "tables": [], "cross_references": [], "footnotes": [{"page": 1, "marker": "1", "text": "n"}]}))
    truth = src.read_ground_truth(spark, f"{tmp_path}/gt")
    assert truth["articles"].first().document_id == "law" and truth["footnotes"].count() == 1 and truth["tables"].count() == 0
    (tmp_path / "ob.json").write_text(json.dumps({"obligations": [{"node_id": "o", "description": "d"}], "relationships": [{"article_node_id": "a", "obligation_node_id": "o"}]}))
    nodes, rels = src.read_obligations(spark, f"{tmp_path}/ob.json")
    assert nodes.first().node_id == "o" and rels.first().obligation_node_id == "o"
    pages = spark.createDataFrame([("d", 2, "b", 1.5), ("d", 1, "a", 2.0)], "source_id string, page int, content string, ms double")
    assert src.assembled(pages).first().full_text == "a\n\nb"


def test_stream_equals_batch(spark, tmp_path):
    from regspark.operators.chunking import chunk_corpus

    schema = "source_id string, instrument_type string, jurisdiction string, full_text string"
    first = spark.createDataFrame([("a", "statute", "EU", "Article 1\nold"), ("b", "guidance", "EU", "1 Intro\ntext")], schema)
    second = spark.createDataFrame([("a", "statute", "EU", "Article 1\nnew\nArticle 2\nmore")], schema)
    for df in (first, second):
        df.write.mode("append").parquet(f"{tmp_path}/in")
        chunk_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.chunk_id, r.text) for r in chunk_table(spark, f"{tmp_path}/out").read().collect()}
    want = {(r.chunk_id, r.text) for r in chunk_corpus(first.where("source_id = 'b'").unionByName(second)).collect()}
    assert got == want


def test_lsh_moves_no_pairs(spark):
    """What the search shuffles are the k best of a query and a pack: the plan has no exchange below the product, and every candidate counts."""
    r = [[float((7 * i + 3 * j * j) % 11 - 5) for j in range(6)] for i in range(300)]
    c = spark.createDataFrame([(i, v) for i, v in enumerate(r)] + [(900, r[0]), (901, [0.0] * 6), (902, None)], "chunk_id long, vec array<double>")
    q = c.where("chunk_id % 60 = 0 and chunk_id < 300").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = se.top_k_lsh(q, c, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted((x.query_id, x.chunk_id) for x in found.collect()) == sorted((x.query_id, x.chunk_id) for x in se.top_k(q, c, 5).collect())


def test_first_relevant_rows_have_their_rank_among_all(spark):
    """Equal vectors wherever they stand are ties by id, and a first hit far behind the k best has its own rank."""
    import numpy as np

    r = np.random.RandomState(3)
    v = [r.normal(size=7).tolist() for _ in range(200)]
    rows = [(i, v[i % 150], (0 if i % 150 in (0, 50, 149) else 1) if i != 100 else None) for i in range(200)]
    c = spark.createDataFrame(rows, "chunk_id long, vec array<double>, label int").repartition(7)
    q = spark.createDataFrame([rows[i] for i in (0, 50, 100, 30)], "query_id long, query_vec array<double>, query_label int")
    m = np.array([x[1] for x in rows], np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = se.first_relevant(q, c, 4).collect()
    for i in (0, 50, 100, 30):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        hits = [n for n, j in enumerate(order, 1) if rows[j][2] is not None and rows[j][2] == rows[i][2]]
        mine = sorted((x["rank"], x.relevant) for x in got if x.query_id == i)
        assert mine == sorted({(n, n in hits) for n in range(1, 5)} | {(n, True) for n in hits[:1]})


def test_equal_vectors_have_equal_similarities_in_any_pack(spark):
    import numpy as np

    r = np.random.RandomState(5)
    m = r.normal(size=(3000, 64)).astype(np.float32).astype(float)
    m[2999] = m[1500] = m[0]
    s = se.exact_cosines(m[:5], m)
    alone = se.exact_cosines(m[:5], m[1500:1501])
    assert (s[:, 0] == s[:, 2999]).all() and (s[:, 0] == s[:, 1500]).all() and (s[:, 0] == alone[:, 0]).all()
    total = 0.0
    for a, b in zip(m[1], m[7], strict=True):
        total += a * b
    squares = [0.0, 0.0]
    for k, i in enumerate((1, 7)):
        for a in m[i]:
            squares[k] += a * a
    assert s[1, 7] == total / np.sqrt(squares[0] * squares[1])
