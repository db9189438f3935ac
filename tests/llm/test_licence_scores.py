"""The licence classifier: scores against plain Python, licences it was not trained on, rows that share a key."""

import math
import re

import pytest

from regspark.llm import licenses as li

from .conftest import prose


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, documents):
    return li.trained(spark, li.licence_free(li.corpus_sample(documents)))


def brute(text: str | None, weights: dict, model: li.Model) -> tuple:
    """n_paragraphs, n_licensed, family, families, n_unknown of one text."""
    owners = [f for f, ts in li.TEMPLATES.items() for _ in ts]
    paragraphs = n_unknown = 0
    confirmed = []
    for nth, line in enumerate((text or "").split("\n")):
        w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", line.lower())
        if not w:
            continue
        paragraphs += 1
        grams = {*w, "^", *(f"{a} {b}" for a, b in zip(w, [*w[1:], "$"], strict=True))} & weights.keys()
        z = [sum(weights[g][0][i] for g in grams) / model.temperature for i in range(len(model.labels))]
        e = [math.exp(x - max(z)) for x in z]
        p = {f: x / sum(e) for f, x in zip(model.labels, e, strict=True)}
        if p[li.NONE] >= 0.5:
            continue
        held = [sum(weights[g][1][t] for g in grams) / min(model.sizes[t], max(1, 2 * len(w))) for t in range(len(owners))]
        best = max((f for f in model.labels if f not in (li.NONE, li.UNKNOWN)), key=lambda f: p[f])
        if p[best] >= model.likely and max(h for h, o in zip(held, owners, strict=True) if o == best) >= li.CONFIRMED:
            confirmed.append((p[best], -nth, best))
        else:
            n_unknown += 1
    return paragraphs, len(confirmed), max(confirmed)[2] if confirmed else None, ",".join(sorted({c[2] for c in confirmed})), n_unknown


NOTICES = (
    "SPDX-License-Identifier: Apache-2.0", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GNU Affero General Public License v3", "CC0 1.0 Universal", "Distributed under the SIL Open Font License, Version 1.1", "He lost his licence", prose(5, 30), "", "Copyright (c) 2020 A\n\nAll rights reserved.\nMIT licensed.",
)


def test_scores_equal_brute_force(spark, documents, model):
    weights = {r.gram: (r.w, r.held) for r in model.weights.collect()}
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    got = {r.doc_id: tuple(r)[1:6] for r in li.license_scan(docs, model=model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) > 200
    assert got == {r.doc_id: brute(r.text, weights, model) for r in rows}
    assert sum(x[1] for x in got.values()) > 5


def test_licences_it_does_not_know(spark, model):
    """Families that no notice is of are unknown; likes of a family get that family and no other."""
    cases = {
        "Distributed under the SIL Open Font License, Version 1.1": (None, 1),
        "Licensed under the Artistic License 2.0": (None, 1),
        "The taxi driver who lost his licence went home": (None, 0),
        "It was the best of times and the worst of times": (None, 0),
        "licensed under the GNU Lesser General Public License v2.1 or later": ("lgpl", 0),
        "GNU Affero General Public License v3": ("agpl", 0),
        "CC0 1.0 Universal": ("public-domain", 0),
        "and it is said that all of it was Released under the MIT License. which they then told everyone in the house": ("mit", 0),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.family, r.n_unknown) for r in li.license_scan(df, model=model).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_rows_have_verdicts_of_their_own(spark, model):
    rows = [(1, "plain words only here"), (1, "Released under the MIT License."), (None, "All rights reserved."), (None, None), (2, "MIT licensed."), (2, "MIT licensed.")]
    got = sorted((r.doc_id or 0, r.family or "", r.n_licensed) for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect())
    assert got == [(0, "", 0), (0, "proprietary", 1), (1, "", 0), (1, "mit", 1), (2, "mit", 1), (2, "mit", 1)]


def test_calibration_is_of_use(model):
    assert model.figures["rows"] > 300 and model.figures["accuracy"] > 0.95 and model.figures["calibration_error"] < 0.05
    sure = [("a", [9.0, 0.0, 0.0])] * 60 + [("b", [9.0, 0.0, 0.0])] * 40  # right in 60 of 100
    temperature, likely, _ = li.calibrated(["a", "b", li.NONE], sure)
    assert temperature > 5 and likely > 0.9
