"""The n-gram Jaccard join against all pairs of documents."""

import random

import numpy as np
import pytest

from regspark.llm import jaccard_join as jj
from regspark.llm import set_links as sl
from regspark.llm.queries import QUERIES

from .conftest import by_id, prose
from .test_near_copies import alike, edited
from .test_text_operators import groups


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows: list[tuple]) -> dict:
    """doc_id: (n_shingles, component_id)."""
    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and alike(sets[a], sets[b])]
    roots = groups(keys, links)
    return {k: (len(sets[k]), roots[k]) for k in keys}


def copies(passage: bool = True) -> list[tuple[int, str]]:
    """Copies at similarities around 0.8, of sizes around the edges of bands, with a passage that all of them quote."""
    out, quote = [], " " + prose(99, 60) if passage else ""
    for k, n in enumerate([6, 8, 9, 12, 20, 40, 62, 64, 70, 79, 83, 99, 101, 120, 124, 160, 200, 243, 310, 500]):
        base = prose(300 + k, n)
        out.append((100 * k + 7, base + quote))
        out += [(100 * k + 10 + e, edited(base, e, 50 * k + e) + quote) for e in range(1, max(2, min(9, n // 9)))]
        out.append((100 * k + 30, base + " " + prose(800 + k, max(1, n // 5)) + quote))
    chain = prose(5000, 200)
    for k in range(8):
        chain = edited(chain, 3, k)
        out.append((9000 + k, chain))
    return out


def got_of(df) -> dict:
    return {k: (r.n_shingles, r.component_id) for k, r in by_id(df).items()}


@pytest.mark.parametrize("passage", [False, True])
def test_copies_equal_brute_force(spark, passage):
    rows = copies(passage)
    want = brute(rows)
    assert sum(root != k for k, (_, root) in want.items()) > 40
    assert got_of(jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_every_similar_pair_shares_what_each_needs():
    """The bound itself: two sets at the line have `need` signatures in common, in a band that both have."""
    r = np.random.default_rng(2)
    tried = 0
    for _ in range(400):
        a = int(r.integers(4, 900))
        b = int(r.integers(a, 5 * a // 4 + 1))
        both = -(-4 * (a + b) // 9)
        if both > a or 5 * both < 4 * (a + b - both):
            continue
        x = r.integers(0, 2**63, a + b - both).astype(np.uint64)
        one, two = x[:a], np.concatenate([x[:both], x[a:]])
        which, bands, need, sig, at = jj.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]))
        sigs = [{int(bands[p]): set(sig[at == p].tolist()) for p in np.flatnonzero(which == k)} for k in (0, 1)]
        needs = [{int(bands[p]): int(need[p]) for p in np.flatnonzero(which == k)} for k in (0, 1)]
        shared = set(sigs[0]) & set(sigs[1])
        assert shared
        for band in shared:
            assert len(sigs[0][band] & sigs[1][band]) >= max(1, needs[0][band], needs[1][band])
        tried += 1
    assert tried > 300


def test_small_groups_of_nodes_and_one_bucket_are_the_same(spark, monkeypatch):
    rows = copies()[:80]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jj, "NODES", 7)
    assert got_of(jj.jaccard_components(d)) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_clusters_by_representatives(spark, monkeypatch, rounds):
    """Chunks of a few sets, so that clusters take rounds and pairs of chunks."""
    monkeypatch.setattr(sl, "CHUNK", 900)
    monkeypatch.setattr(sl, "ROUNDS", rounds)
    base = prose(1, 120)
    rows = [(k, edited(base, 1 + k % 7, k)) for k in range(60)] + copies(passage=False)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert got_of(jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute(rows)


def test_all_sets_in_one_cluster_lose_no_link(spark, monkeypatch):
    """similar_within alone, given one cluster of everything."""
    from regspark.llm.components import components
    from regspark.llm.simhash import shingle_hashes

    monkeypatch.setattr(sl, "CHUNK", 3000)
    rows = copies(passage=False)
    sets = spark.createDataFrame([(k, np.unique(shingle_hashes(t.encode(), 5)).view(np.int64).tolist()) for k, t in rows], "node long, shingles array<long>")
    clusters = sets.selectExpr("node", "0L AS root")
    roots = {r.node: r.root for r in components(sl.similar_within(clusters, sets)).collect()}
    want = brute(rows)
    assert {k: roots.get(k, k) for k in want} == {k: root for k, (_, root) in want.items()}


def test_odd_rows(spark, docs, empty):
    got = got_of(jj.jaccard_components(docs))
    first: dict = {}
    for r in docs.collect():
        first[r.doc_id] = r.text
    assert got == brute(list(first.items()))
    assert jj.jaccard_components(docs).count() == docs.count()
    assert jj.jaccard_components(empty).count() == 0
    text = prose(1, 80)
    nulls = spark.createDataFrame([(None, text), (4, text), (None, ""), (9, None)], "doc_id long, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(nulls).collect()]
    assert sorted(found, key=str) == sorted([(None, 76, 4), (4, 76, 4), (None, 0, None), (9, 0, 9)], key=str)


def test_query_over_a_whole_table(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, prose(r.randrange(90), 60 + k % 5)) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got_of(QUERIES["op13_jaccard_join"](spark, str(tmp_path))) == brute(rows)
