"""Windows that many items share, shards and parts of a search that are cut small, and sequences of texts without prompts."""

import random
import tracemalloc

import pytest

from regspark.llm import decontaminate as dc
from regspark.llm.packing import LIMITS, Bins, pack_sequences

from .conftest import prose


def brute(documents: list[str], items: dict[str, str]) -> list[tuple[set, set]]:
    out = []
    for text in documents:
        w, hit, names = dc.words_of(text.encode()), set(), set()
        for name, item in items.items():
            q = dc.words_of(item.encode())
            k = min(10, len(q))
            windows = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else set()
            for i in range(len(w)):
                if tuple(w[i : i + k]) in windows and k:
                    hit |= set(range(i, i + k))
                    names.add(name)
        out.append((hit, names))
    return out


def scanned(documents: list[str], items: dict[str, str]) -> list[tuple[set, set]]:
    phrases = dc.Phrases([(k, v.encode()) for k, v in items.items()])
    got = phrases.scan([dc.words_of(x.encode()) for x in documents])
    names = phrases.names.to_pylist()
    return [({i for a, b in spans for i in range(a, b)}, {names[k] for k in phrases.items_of(found)}) for spans, found in got]


def cases(seed: int) -> tuple[list[str], dict[str, str]]:
    r, common = random.Random(seed), prose(77, 14)
    items = {f"i{k}": " ".join([prose(seed + k, r.randint(0, 12)), common if k % 3 else "", prose(seed + 50 + k, r.randint(0, 3))]) for k in range(12)}
    items |= {"one": "in", "two": "in jo", "same": items["i1"], "none": " ,; "}
    documents = [" ".join(r.choice([prose(r.randrange(999), 9), common, r.choice(list(items.values())), "in", "in jo in jo"]) for _ in range(r.randint(0, 5))) for _ in range(25)]
    return documents, items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("searched", [3, 1 << 18])
def test_scan_equals_brute_force(monkeypatch, seed, searched):
    monkeypatch.setattr(dc, "SEARCHED", searched)
    documents, items = cases(seed)
    assert scanned(documents, items) == brute(documents, items)
    spans = [s for s, _ in dc.Phrases([(k, v.encode()) for k, v in items.items()]).scan([dc.words_of(x.encode()) for x in documents])]
    assert all(a[1] < b[0] for s in spans for a, b in zip(s, s[1:], strict=False))  # merged


def test_small_shards_and_lists_are_the_same(spark, monkeypatch):
    documents, items = cases(3)
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string").coalesce(1)
    tests = spark.createDataFrame(list(items.items()), "item_id string, text string")
    rows = lambda: sorted((r.doc_id, r.n_words, tuple(r.spans), tuple(r.items)) for r in dc.contamination(docs, tests).collect())
    one = rows()
    monkeypatch.setattr(dc, "SHARD_SYMBOLS", 20)
    monkeypatch.setattr(dc.shards, "__defaults__", (20,))
    monkeypatch.setattr(dc, "LISTED", 5)
    assert rows() == one and any(r[3] for r in one)


def test_one_window_of_many_items_is_searched_once():
    """20,000 items with one common window, 1,000 occurrences."""
    common = prose(5, 10)
    tracemalloc.start()
    phrases = dc.Phrases([(f"i{k}", f"{common} w{k}".encode()) for k in range(20_000)])
    got = phrases.scan([dc.words_of(f"x {common} y".encode())] * 1000)
    assert all(spans == [(1, 11)] for spans, _ in got) and len(phrases.items_of(got[0][1])) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def share_of_full(examples: list[tuple[int, int]]) -> float:
    out, bins = {}, None
    bins = Bins(LIMITS, 0, lambda k, start, n, s, at: out.setdefault(s, []).append((n, bins.loss(k, start, start + n))))
    bins.pack(examples)
    sizes = [sum(n for n, _ in s) for s in out.values()]
    assert all(n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(n for n, _ in examples)
    assert all(len(s) <= LIMITS[1] and sum(x for _, x in s) <= LIMITS[2] for s in out.values())
    return sum(n for n in sizes if n == LIMITS[0]) / sum(sizes)


def test_nearly_all_tokens_lie_in_full_sequences():
    r = random.Random(1)
    plain = [(n, n) for n in (r.randint(500, 1399) for _ in range(500))]
    asked = [(n, int(n * r.uniform(0.03, 0.3))) for n in (r.randint(100, 3000) for _ in range(300))]
    assert min(map(share_of_full, (plain, asked, plain + asked))) >= 0.95


def test_the_limit_does_not_count_plain_texts(spark):
    """A text of one line fills sequences, though all of it bears loss; a number of prompt tokens makes it an instruction."""
    rows = [(1, prose(1, 900), None), (3, prose(3, 900), 5), (4, prose(4, 900), 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, free long").coalesce(1)
    pieces = pack_sequences(d).collect()
    assert all(r.n_loss == r.length for r in pieces) and any(r.length == 1024 for r in pieces)
    loss: dict = {}
    for r in pack_sequences(d, prompt_tokens="free").collect():
        loss.setdefault(r.sequence_id, []).append((r.doc_id, r.n_loss))
        assert r.doc_tokens > 1024
    assert all(sum(n for k, n in s if k != 1) <= LIMITS[2] for s in loss.values())


def test_small_blocks_of_tokens_pack_the_same_ids(spark, monkeypatch):
    from regspark.llm import packing

    d = spark.createDataFrame([(k, prose(k, 300)) for k in range(12)], "doc_id long, text string").coalesce(1)
    tokens = lambda: {r.doc_id: r.n for r in pack_sequences(d).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    whole = tokens()
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 700)
    assert tokens() == whole
