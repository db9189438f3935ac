"""Periodic runs against a search of every lag at every word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from regspark.llm import periodic_runs as pr
from regspark.llm.queries import QUERIES

from .conftest import by_id


def brute(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    out: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def found(texts: list[list[bytes]]) -> list[list[tuple]]:
    runs, out, base = pr.runs_of(pr.numbered(texts), max(map(len, texts), default=0)).tolist(), [], 0
    for w in texts:
        out.append([(s - base, n, q) for s, n, q in runs if base <= s < base + len(w)])
        base += len(w)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 90), st.integers(0, 10**6)), max_size=4))
def test_batches_equal_brute_force(shapes):
    texts = []
    for letters, n, seed in shapes:
        r = random.Random(seed)
        w = [str(r.randrange(letters)).encode() for _ in range(n)]
        if n > 8:
            p, a = r.randint(1, n // 3), r.randrange(n)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if r.random() < 0.4:
                w[r.randrange(n)] = b"other"
        texts.append(w)
    assert found(texts) == [brute(w) for w in texts]


def test_nested_and_long_runs():
    inner = [b"a"] * 7 + [b"b"]
    text = inner * 9 + [b"c", *(b"%d" % (i % 300) for i in range(1500))]
    assert found([text]) == [brute(text)]
    assert (0, 7, 1) in brute(text) and any(q == 300 for _, _, q in brute(text))


def test_one_word_repeated_is_one_run_in_linear_time():
    n = 300_000
    assert pr.runs_of(np.zeros(n, np.int64), n).tolist() == [[0, n, 1]]


def test_runs_of_odd_rows(spark, docs, empty):
    got = by_id(pr.periodic_runs(docs))
    for doc_id, text in {(r.doc_id, r.text) for r in docs.collect()}:
        w = (text or "").encode().split()
        runs = brute(w) if len(w) < 2000 else [tuple(r) for r in got[doc_id].runs]
        assert [tuple(r) for r in got[doc_id].runs] == runs
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[doc_id].collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert pr.periodic_runs(docs).count() == docs.count()
    assert pr.periodic_runs(empty).count() == 0 and pr.run_digest(pr.periodic_runs(pr.damaged(empty))).count() == 0
    nulls = spark.createDataFrame([(None, "a a a a a a"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.runs) for r in pr.periodic_runs(nulls).collect()) == [0, 1]
    assert pr.damaged(nulls).where("text is not null").count() == 1


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, " ".join(f"w{r.randrange(k % 7 + 2)}" for _ in range(r.randint(0, 150)))) for k in range(250)]
    spark.createDataFrame([*rows, (300, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op11_periodic_runs"](spark, str(tmp_path)))
    planted = 0
    for k, text in [*rows, (300, "")]:
        w, h = text.split(), zlib.crc32(str(k).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs = brute(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want = (k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(got[k]) == want
    assert planted > 10
