"""Sorted buckets and their boundaries against one sort of everything; texts longer than a part."""

import collections
import random

import numpy as np
import pyarrow as pa

from regspark.llm import substring_dedup as sd

from .conftest import prose


def test_multikey_order_sorts_by_all_keys():
    r = np.random.default_rng(1)
    keys = [r.integers(0, 5, 400), r.integers(0, 4, 400), r.integers(0, 3, 400)]
    order = sd.multikey_order(keys)
    assert [tuple(int(k[i]) for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys), strict=True))


def test_boundaries_settle_what_crosses_them():
    """Runs of one core and of one content over several buckets, whole buckets of one content, and empty ones."""
    r = random.Random(3)
    for trial in range(60):
        cores = r.choice([2, 5, 40])
        rows = sorted((r.randrange(cores), r.choice([0, 0, 0, 1, 2, r.randrange(50)]), u) for u in range(120))
        cuts = sorted(r.sample(range(121), 7))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 120], strict=True)]
        out, edges = [], []
        for bucket, part in enumerate(parts):
            if not part:
                continue
            mixed = r.sample(part, len(part))
            column = {x: [m[i] for m in mixed] for i, x in enumerate(("core", "content", "u"))}
            table = pa.table({**column, "at": column["u"], "first": column["u"], "last": column["u"], "n": [1] * len(part)})
            for row in sd.settled_bucket(table, bucket).to_pylist():
                if row["edge"]:
                    edges.append((bucket, row["edge"]))
                else:
                    out.append(row)
        known = {x[0]: x[1:] for x in sd.boundary_rows(edges)}
        same, varied, lead = set(), set(), collections.Counter()
        for x in out:
            core_a, content_a, core_z, content_z, same_a, same_z, varied_a, varied_z = known[x["bucket"]]
            head, tail = (x["core"], x["content"]) == (core_a, content_a), (x["core"], x["content"]) == (core_z, content_z)
            if x["same"] or head and same_a or tail and same_z:
                same.add(x["u"])
            if x["varied"] or x["core"] == core_a and varied_a or x["core"] == core_z and varied_z:
                varied.add(x["u"])
                lead[x["core"], x["content"]] += x["lead"] and not (head and same_a)
        times = collections.Counter(x[:2] for x in rows)
        contents = collections.defaultdict(set)
        for c, k, _ in rows:
            contents[c].add(k)
        assert same == {u for c, k, u in rows if times[c, k] > 1}, trial
        assert varied == {u for c, _, u in rows if len(contents[c]) > 1}, trial
        assert set(lead.values()) <= {1} and len(lead) == sum(len(x) for x in contents.values() if len(x) > 1), trial


def test_many_small_buckets_are_one(spark, docs, monkeypatch):
    want = sorted(map(str, sd.cut_repeats(docs).collect()))
    monkeypatch.setattr(sd, "BUCKET", 20)
    monkeypatch.setattr(sd, "CROWD", 0)
    assert sorted(map(str, sd.cut_repeats(docs).collect())) == want


def test_text_longer_than_a_part(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = "".join(r.choices(letters, k=sd.PART + 200_000))
    passage, crossing = prose(9, 200)[:700], text[sd.PART - 300 : sd.PART + 300]
    other = "".join(r.choices(letters, k=900)) + passage + "".join(r.choices(letters, k=500)) + crossing
    text = text[:1000] + passage + text[1000 + len(passage) :]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in sd.cut_repeats(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()}
    assert got == {1: (1300, 2), 2: (1300, 2)}
