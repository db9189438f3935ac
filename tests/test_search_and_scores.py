"""Vector search in packs, the featuriser, rules, prices, edit distance and the way from questions to seeds."""

import random

import numpy as np
import pytest

from regspark.functions.scores import edits
from regspark.operators import evaluate as ev
from regspark.operators import interpret as it
from regspark.operators import search as se


def vectors(n: int, seed: int = 1) -> list[tuple]:
    """Vectors with copies (ties), a zero one and a null one; two columns to filter by."""
    r = random.Random(seed)
    out = [(f"c{i:03}", [r.uniform(-1, 1) for _ in range(8)], r.choice(["EU", "CH", None]), r.choice("abc")) for i in range(n)]
    out += [(f"d{i}", out[i % 3][1], "EU", "a") for i in range(6)] + [("z0", [0.0] * 8, "EU", "a"), ("z1", None, "CH", "b")]
    return out


def brute(queries, corpus, k: int) -> list[tuple]:
    def unit(v):
        x = np.array(v if v is not None else [0.0] * 8, np.float32).astype(float)
        return x / (np.linalg.norm(x) or 1)

    out = []
    for q, vec, js, fs in queries:
        rows = [(-round(float(unit(vec) @ unit(v)), 12), c) for c, v, j, f in corpus if (not js or j in js) and (not fs or f in fs)]
        out += [(q, c, i + 1) for i, (_, c) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sent", [1 << 26, -1])
@pytest.mark.parametrize("filters", [None, {"j": "js"}, {"j": "js", "f": "fs"}])
def test_top_k_equals_brute_force(spark, monkeypatch, sent, filters):
    monkeypatch.setattr(se, "SENT", sent)
    monkeypatch.setattr(se, "QUERY_BLOCK", 96)  # blocks of three queries
    corpus = vectors(60)
    r = random.Random(2)
    queries = [(i, [r.uniform(-1, 1) for _ in range(8)], r.choice([[], None, ["EU"], ["CH", "EU", "EU"], ["XX"]]), r.choice([[], ["a"], ["b", "c"]])) for i in range(9)] + [(90, [0.0] * 8, [], []), (91, corpus[0][1], [], [])]
    c = spark.createDataFrame(corpus, "chunk_id string, vec array<double>, j string, f string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, query_vec array<double>, js array<string>, fs array<string>")
    got = se.top_k(q if filters else q.drop("js", "fs"), c, 7, filters)
    used = [(a, b, js if filters else [], fs if filters and "f" in filters else []) for a, b, js, fs in queries]
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(used, corpus, 7)
    assert se.top_k(q.drop("js", "fs"), c.limit(0), 3).count() == 0 and se.top_k(q.drop("js", "fs").limit(0), c, 3).count() == 0


def test_a_text_has_one_vector_in_any_set(spark):
    corpus = spark.createDataFrame([(1, "Data protection, data transfer"), (2, "transfer of persons"), (3, None), (4, "controller duties")], "id int, text string")
    model = se.fitted(corpus, "text", 64)
    alone = se.embedded(corpus.where("id = 1"), "text", model).first().vec
    among = se.embedded(corpus.unionByName(corpus), "text", model).where("id = 1").collect()
    assert all(r.vec == alone for r in among) and sum(x * x for x in alone) == pytest.approx(1)
    assert set(se.embedded(corpus.where("id = 3"), "text", model).first().vec) == {0.0}
    assert model.count() == 64 and {r.documents for r in model.collect()} == {4}


def test_chunks_found_by_their_own_texts(spark):
    """Top-k over real chunk texts: a chunk's own words find it first, or an equal text."""
    from regspark.plans.graph_queries import Graph

    chunks = Graph(spark, "/root/testdata/sf0.001").chunks.select("chunk_id", "text")
    model = se.fitted(chunks, "text").cache()
    c = se.embedded(chunks, "text", model)
    q = c.where("conv(substr(chunk_id, 1, 2), 16, 10) < 4").select(c["chunk_id"].alias("query_id"), c["vec"].alias("query_vec"), c["text"].alias("asked"))
    first = se.top_k(q, c, 1)
    assert first.count() > 10 and first.where("similarity < 0.999999 and similarity > 0").count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edits_equal_the_table():
    r = random.Random(4)
    for _ in range(800):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert edits(a, b) == levenshtein(a, b)


def test_edits_of_long_transcripts():
    r = random.Random(5)
    said = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    heard = [w for i, w in enumerate(said) if i % 10] + ["more"] * 5
    assert 1990 <= edits(said, heard) <= 2005
    assert edits(said, said) == 0 and edits(said, []) == 20_000


def test_rules_by_field_source_and_order(spark):
    chunks = spark.createDataFrame(
        [("1", "gdpr", "Article 6", ["Article 7", "Article 9"], None), ("2", "fadp", None, [], "text of Article 6"), ("3", "gdpr", "Article 60", None, "x")],
        "chunk_id string, source_id string, article string, cross_references array<string>, text string",
    )
    rules = [
        ("q", 1, 2, "gdpr", "article", "^Article 6$"), ("q", 2, 1, None, "text", "Article 6"), ("q", 3, 9, None, "article", "Article"),
        ("lists", 1, 1, None, "cross_references", "7 Article 9$"), ("none", 1, 1, None, "unknown", "^$"), ("never", 1, 1, "edpb", "article", ""), ("nulls", 1, 3, None, "text", "^$"),
    ]
    r = spark.createDataFrame(rules, "query_id string, rule_order int, level int, rule_source string, match_field string, pattern string")
    got = {(x.query_id, x.chunk_id): x.level for x in ev.relevance_levels(r, chunks, ["article", "cross_references", "text"]).collect()}
    assert got == {("q", "1"): 2, ("q", "2"): 1, ("q", "3"): 9, ("lists", "1"): 1, ("none", "1"): 1, ("none", "2"): 1, ("none", "3"): 1, ("nulls", "1"): 3}


def test_costs_and_summaries(spark):
    rows = spark.createDataFrame([("a", 1000, 500, 10.0), ("a", 3000, None, 20.0), ("free", 5, 5, None)], "model string, input_tokens long, output_tokens long, latency_ms double")
    prices = spark.createDataFrame([("a", 2.0, 4.0)], "model string, per_million_input double, per_million_output double")
    paid = ev.costs(rows, prices)
    assert sorted((r.cost_usd for r in paid.where("model = 'a'").collect())) == pytest.approx([0.004, 0.006]) and paid.where("model = 'free'").first().cost_usd is None
    scored = paid.selectExpr("*", "true AS evidence_sufficient", "true AS expressed_uncertainty", "1.0 AS citation_precision", "0.5 AS citation_recall", "false AS calibration_correct")
    a = ev.answer_summary(scored).where("model = 'a'").first()
    assert (a.avg_latency_ms, a.avg_cost_usd, a.false_refusal_rate, a.insufficient_rate) == (15.0, 0.005, 1.0, 0.0)
    spoken = spark.createDataFrame([("m", "none", True, "A", 0.1, 0.2, 3, 5.04), ("m", "none", True, "A", 0.3, 0.0, 4, 5.0)], "model string, preprocessing string, context_biasing boolean, category string, wer double, entity_wer double, fabricated int, latency_ms double")
    s = ev.transcript_summary(spoken).first()
    assert (s.avg_wer, s.avg_fabricated, s.avg_latency_ms, s.cat_a_wer, s.cat_b_wer, s.cat_b_entity_wer) == (0.2, 3.5, 5.0, 0.2, 0.0, 0.0)
    pages = spark.createDataFrame([("d", 0, 5.0), ("e", 4, 10.0)], "source_id string, pages int, total_ms double")
    assert {r.source_id: r.ms_per_page for r in ev.ms_per_page(pages).collect()} == {"d": 5.0, "e": 2.5}


def test_seeds_of_hits_only_for_questions_that_name_none(spark):
    q = spark.createDataFrame([("named", ["gdpr:Article 9", "gdpr:Article 1"]), ("silent", []), ("lost", [])], "query_id string, refs array<string>")
    hits = spark.createDataFrame([(k, r, "gdpr", f"Article {a}") for k in ("named", "silent") for r, a in enumerate([3, 2, 3, 5, 6, 7, 8], 1)], "query_id string, rank int, source_id string, article string")
    got = sorted((r.query_id, r.place, r.ref, r.named) for r in it.seeds_of_questions(q, hits).collect())
    assert got == [("named", 1, "gdpr:Article 9", True), ("named", 2, "gdpr:Article 1", True)] + [("silent", i, f"gdpr:Article {a}", False) for i, a in enumerate([3, 2, 5, 6, 7], 1)]


def test_status_of_questions_without_words_or_context(spark):
    q = spark.createDataFrame([("a", "What?"), ("b", ""), ("c", "Why?")], "query_id string, question string")
    prompts = spark.createDataFrame([("a", "passages", 3, 1), ("b", "", 0, 0), ("c", " \n", 0, 0)], "query_id string, prompt string, n_passages long, n_items long")
    answers = spark.createDataFrame([("a", "By Article 6."), ("c", "By Article 7.")], "query_id string, answer string")
    got = {r.query_id: (r.n_hits, r.n_items, r.confidence, len(r.errors), r.stages[1], r.stages[3]) for r in it.status(q, prompts, answers).collect()}
    assert got == {"a": (3, 1, "sufficient", 0, "retrieve", "generate"), "b": (0, 0, "insufficient_evidence", 2, "retrieve:error", "generate:error"), "c": (0, 0, "insufficient_evidence", 1, "retrieve", "generate:error")}


def test_cells_find_nine_of_ten_and_compare_a_fifth(spark):
    """Over chunk texts: the share of the exact ten best (or of equals), and of all pairs that are compared."""
    from pyspark.sql import functions as F

    from regspark.operators import ann
    from regspark.plans import question_queries as qq
    from regspark.plans.graph_queries import Graph
    from regspark.sources.tables import stored

    graph = Graph(spark, "/root/testdata/sf0.01")
    vectors = stored(qq._chunk_vectors(graph)[1].select("chunk_id", "vec"), "vectors")
    asked = graph.chunks.where("cast(substr(source_id, 4) as bigint) % 50 = 0").select("chunk_id")
    queries = stored(vectors.join(asked, "chunk_id").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec")), "asked")
    exact = stored(se.top_k(queries, vectors, 10).select("query_id", F.col("similarity").alias("s")), "exact")
    to = ann.centres(vectors, qq.CELLS)
    index = stored(ann.indexed(vectors, to), "index")
    assert index.count() == vectors.count()
    got = ann.top_k_cells(queries, index, to, 10, qq.PROBES).join(exact.groupBy("query_id").agg(F.min("s").alias("tenth")), "query_id")
    assert got.where("similarity >= tenth - 1e-9").count() >= 0.9 * exact.count()
    assert ann.compared(queries, index, to, qq.PROBES) < 0.2 * vectors.count() * queries.count()


def test_crowded_cells_are_split(spark):
    """A close group of three quarters of all rows gets the spare centres, whatever the seed; no row is lost."""
    from regspark.operators import ann

    r = np.random.RandomState(8)
    rows = np.vstack([r.normal(size=(400, 16)), np.eye(16)[0] + 0.001 * r.normal(size=(1200, 16))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(f"c{i:04}", x.tolist()) for i, x in enumerate(rows)], "chunk_id string, vec array<double>")
    queries = corpus.selectExpr("chunk_id AS query_id", "vec AS query_vec")
    for seed in (1, 2):
        to = ann.centres(corpus, 64, seed=seed)
        assert len(to) <= 64 and np.allclose(np.linalg.norm(to, axis=1), 1)
        index = ann.indexed(corpus, to)
        assert index.count() == len(rows) and index.groupBy("cell").count().agg({"count": "max"}).first()[0] < 0.25 * len(rows)
        assert ann.compared(queries, index, to, 1) < 0.2 * len(rows) ** 2


def test_vectors_of_asked_chunks_are_those_stored_and_nothing_is_moved(spark):
    from regspark.plans import question_queries as qq
    from regspark.plans.graph_queries import Graph

    graph = Graph(spark, "/root/testdata/sf0.001")
    asked = qq._asked_chunks(graph)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    ids = {r.chunk_id for r in graph.chunks.where("cast(substr(source_id, 4) as bigint) % 50 = 0").collect()}
    want = {r.chunk_id: r.vec for r in qq._chunk_vectors(graph)[1].collect() if r.chunk_id in ids}
    assert want and {r.query_id: r.query_vec for r in asked.collect()} == want and asked.count() == len(want)


def test_spare_centres_go_where_a_centre_has_most_rows():
    from regspark.operators import ann

    assert ann.shares({0: 100, 1: 10, 2: 31}, 4) == {0: 4, 1: 1, 2: 2}
    assert ann.shares({3: 1, 4: 2}, 9) == {3: 1, 4: 2} and ann.shares({}, 3) == {}
    same = np.tile([[0.6, 0.8]], (5, 1))
    assert np.allclose(ann.split(same, 3), [[0.6, 0.8]])


def test_best_of_tiles_are_those_of_all_scores():
    """Nearly equal scores, ties and rows that earlier tiles rule out: the k best by twelve places, then by id."""
    r = np.random.RandomState(6)
    two = r.normal(size=(3000, 16))
    two[1000:1400] = two[7]
    two[1400:1800] = two[7] + 1e-9 * r.normal(size=(400, 16))
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    one = np.vstack([two[7], two[9], np.zeros(16), two[2000]])
    ids = r.permutation(3000)
    line = np.full(len(one), -np.inf)
    found = [[] for _ in one]
    for at in range(0, 3000, 1300):
        part = two[at : at + 1300]
        for q, i, s in zip(*se.best_of_tile(one, part, ids[at : at + 1300], 5, line), strict=True):
            found[q].append((-round(s, 12), ids[at + i]))
    for q, rows in enumerate(found):
        scores = np.round(two @ one[q], 12)
        assert [i for _, i in sorted(rows)[:5]] == [i for _, i in sorted(zip(-scores, ids, strict=True))[:5]]
    assert len(found[3]) < 15


def test_many_questions_are_more_passes_and_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(se, "SENT", 200)
    monkeypatch.setattr(se, "QUERY_BLOCK", 96)
    c = spark.createDataFrame([(x[0], x[1], x[2]) for x in vectors(60)], "chunk_id string, vec array<double>, j string")
    q = c.where("vec is not null").select(c["chunk_id"].alias("query_id"), c["vec"].alias("query_vec")).withColumn("js", se.F.array().cast("array<string>"))
    pairs, _, _ = se.meetings(q, c, {"j": "js"})
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") > 2 and "hashpartitioning" not in plan
