"""The pipeline's near-dedup against brute force."""

import random

import corpus_pipeline as cp
from regspark.llm import near_copies as nc

from .conftest import prose
from .test_text_operators import groups


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(text: str, n: int, seed: int) -> str:
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def copies() -> list[tuple[int, str]]:
    """Copies with similarity from below 0.8 to 0.98, and chains whose ends are not alike."""
    out = []
    for k in range(30):
        base = prose(700 + k, 100 + 10 * k)
        out += [(100 * k + 7, base)] + [(100 * k + 10 + n, edited(base, n, 50 * k + n)) for n in range(1, 9)]
    chain = prose(5000, 200)
    for k in range(8):
        chain = edited(chain, 3, k)
        out.append((9000 + k, chain))
    return out


def test_edited_copies_equal_brute_force(spark):
    docs = copies()
    sets = {k: shingles(t) for k, t in docs}
    keys = list(sets)
    linked = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if alike(sets[a], sets[b])]
    assert any(5 * len(sets[a] & sets[b]) < 4.2 * len(sets[a] | sets[b]) for a, b in linked)
    want = sorted(set(groups(keys, linked).values()))
    got = cp.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_many_nodes_by_join_are_the_same(spark, monkeypatch):
    d = spark.createDataFrame(copies()[:60], "doc_id long, text string")
    sent = sorted(r.doc_id for r in nc.one_of_alike(d).collect())
    monkeypatch.setattr(nc, "SENT", -1)
    assert sorted(r.doc_id for r in nc.one_of_alike(d).collect()) == sent


def test_near_copies_of_odd_rows(spark, docs, empty):
    text = prose(1, 80)
    rows = [(4, text), (3, text), (3, text), (None, text), (None, text), (9, None), (8, ""), (7, prose(2, 80)), (7, prose(3, 80)), (11, "two words"), (12, "Two  words")]
    got = nc.one_of_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(3, text), (0, text), (0, text), (8, ""), (7, prose(2, 80)), (7, prose(3, 80)), (11, "two words")])
    assert nc.one_of_alike(docs).columns == docs.columns and nc.one_of_alike(empty).count() == 0
