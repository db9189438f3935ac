"""License scans: a trained paragraph classifier, native DataFrame functions only.

A multinomial logistic regression over word n-grams (words and pairs) tells
licence families, licences of no family (unknown) and other text (none) apart.
It is trained on windows of licence notices, of notices of other licences, of
ordinary sentences that use their words, and on a bounded sample of the corpus.
A third of the windows is held out: there a temperature is fitted to the scores,
and then the least probability at which PRECISE of the families named are right.

Its sparse weights are a table of at most MAX_FEATURES n-grams, so scoring is a
join of the n-grams of each paragraph with that table and a sum per paragraph.
A paragraph that is likelier a licence than not has a family if that is
probable enough and a template confirms it, and is unknown otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Licence notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "The MIT License (MIT)",
        "MIT licensed.",
        "SPDX-License-Identifier: MIT",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose, commercial or non-commercial, and by any means.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
        "This document is confidential and proprietary. Unauthorized copying or distribution is strictly prohibited.",
    ),
}
#: Notices of licences of no family.
OTHERS = (
    "Licensed under the Eclipse Public License 1.0.",
    "This software is provided under the zlib license.",
    "Licensed under the European Union Public Licence.",
    "Distributed under the Boost Software License.",
    "This file is covered by the Artistic License.",
    "Use of this product is subject to the terms of the license agreement.",
    "See the licence agreement for the terms of use.",
    "This data is made available under the Open Database License.",
    "The licensee may use this material under the terms of this licence only.",
    "This work is published under a licence of its own, see the file for its terms.",
    "Licensed to you under a custom licence.",
    "This licence is granted to you for personal use.",
    "By using this software you agree to the terms of this license.",
    "The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability and fitness for a particular purpose.",
    "In no event shall the authors be liable for any claim, damages or other liability.",
)
#: Sentences with words of licences that are none.
ORDINARY = (
    "He lost his driving licence last year.",
    "The driver had no licence.",
    "She asked for permission to leave the room.",
    "They spoke about human rights and the public good.",
    "The general made a public statement.",
    "The work is free of charge for children.",
    "A copy of the letter was found in this file.",
    "Under these conditions the terms were not met.",
    "The source of the river is in this part of the country.",
    "The version of the story that you know is not the first.",
    "All people are free and all of them may use the road.",
    "Copyright is a field of law that few people like.",
    "The bank granted him a loan on the terms that he had asked for.",
    "The foundation published its report for the public.",
    "It is common to share, and creative people do it with pleasure.",
    "The software did not work and the warranty was over.",
)
UNKNOWN, NONE = "unknown", "none"
MAX_FEATURES = 4096
#: The sample of the corpus that shows what is no licence: documents and windows of their paragraphs, picked by hash, and words in a window.
SAMPLED, MAX_NEGATIVES, WINDOW_WORDS = 1000, 4000, 40
#: Share of right families among held-out windows that the least probability is fitted to.
PRECISE = 0.98
#: A template confirms a family that has so much of the paragraph's n-grams, or has so much of its own in the paragraph.
CONFIRMED = 0.6


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, nth, paragraph) for the lines of a text that have a word; numbered among all lines."""
    lines = docs.select(F.col(key), F.posexplode_outer(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")).alias("nth", "paragraph"))
    return lines.where(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def words(paragraph: str = "paragraph") -> Column:
    """Lower-case runs of letters, digits, dots and hyphens between the two."""
    return F.regexp_extract_all(F.lower(F.col(paragraph)), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def ngrams(w: str = "words") -> Column:
    """Words and pairs of neighbours, and the mark of a paragraph's start, which every paragraph has."""
    pairs = F.expr(f"transform(sequence(0, greatest(size({w}) - 2, 0)), i -> concat_ws(' ', {w}[i], coalesce(get({w}, i + 1), '$')))")
    return F.concat(F.col(w), pairs, F.array(F.lit("^")))


def notices(spark: SparkSession) -> DataFrame:
    """(template, label, words) of all templates and other sentences, in their order; families come first."""
    texts = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in OTHERS] + [(NONE, t) for t in ORDINARY]
    listed = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(f).alias("label"), F.lit(t).alias("paragraph")) for k, (f, t) in enumerate(texts)))
    return spark.range(0, 1, 1, 1).select(F.explode(listed).alias("n")).select("n.*").select("template", "label", words().alias("words"))


def training_rows(spark: SparkSession, sample: DataFrame) -> DataFrame:
    """(label, words, held): every notice whole, and windows of half its words or more, a third of them held out; `sample` as none."""
    own = notices(spark).select("label", "words")
    sizes = "array(greatest(3, cast(ceil(size(words) / 2D) as int)), greatest(3, cast(ceil(size(words) * 0.7D) as int)))"
    windows = own.select("label", "words", F.explode(F.expr(sizes)).alias("width")).where("width < size(words)")
    windows = windows.select("label", F.explode(F.expr("transform(sequence(0, size(words) - width), i -> slice(words, i + 1, width))")).alias("words"))
    whole = own.unionByName(own).unionByName(own).withColumn("held", F.lit(False))
    rest = windows.unionByName(sample.select(F.lit(NONE).alias("label"), words().alias("words")))
    return whole.unionByName(rest.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(3)) == 0))


@dataclass
class Model:
    """Weights (gram, w, held): w by label, held by template; the words of its n-grams; temperature and least probability; held-out figures."""

    weights: DataFrame
    labels: list[str]
    parts: list[str]
    sizes: list[int]
    temperature: float
    likely: float
    figures: dict[str, float]


def softmax(z: list[float], temperature: float) -> list[float]:
    top = max(z)
    e = [exp((x - top) / temperature) for x in z]
    return [x / sum(e) for x in e]


def calibrated(labels: list[str], rows: list[tuple[str, list[float]]]) -> tuple[float, float, dict[str, float]]:
    """The temperature with the least log loss over held-out (label, scores), the least probability, and how reliable they are."""
    rows = rows or [(NONE, [0.0] * len(labels))]
    loss = lambda t: -sum(log(max(1e-12, softmax(z, t)[labels.index(label)])) for label, z in rows)
    temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    told = []
    for label, z in rows:
        p = softmax(z, temperature)
        best = max((x, f) for x, f in zip(p, labels, strict=True) if f not in (UNKNOWN, NONE))
        if p[labels.index(NONE)] < 0.5:
            told.append((best[0], best[1] == label))
    steps = [k / 50 for k in range(15, 50)]
    right = {t: [ok for p, ok in told if p >= t] for t in steps}
    likely = next((t for t in steps if right[t] and sum(right[t]) >= PRECISE * len(right[t])), steps[-1])
    tops = [(max(p), p.index(max(p)) == labels.index(label)) for label, z in rows for p in [softmax(z, temperature)]]
    bins = [[x for x in tops if k / 10 <= x[0] < (k + 1) / 10 + (k == 9)] for k in range(10)]
    gap = sum(abs(sum(p for p, _ in b) - sum(ok for _, ok in b)) for b in bins) / len(tops)
    return temperature, likely, {"rows": len(rows), "accuracy": sum(ok for _, ok in tops) / len(tops), "calibration_error": gap}


def trained(spark: SparkSession, sample: DataFrame) -> Model:
    """The classifier, fitted to notices and `sample` (paragraph), whose number of rows the caller bounds."""
    labels = sorted([*TEMPLATES, UNKNOWN, NONE])
    label = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("double") - 1
    weight = F.when(F.col("label") == NONE, 0.1).otherwise(1.0)
    rows = written(training_rows(spark, sample).select(ngrams().alias("grams"), label.alias("label"), weight.alias("weight"), "held").coalesce(1), "licences")  # a bounded table: one small task an iteration
    listed = written(notices(spark).select("template", "label", F.array_distinct(ngrams()).alias("grams")).coalesce(1), "notices")
    # the vocabulary comes from the notices: other words carry no evidence for a family
    space = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=MAX_FEATURES, binary=True).fit(listed)
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, maxIter=60).fit(space.transform(rows.where("not held")))
    scored = model.transform(space.transform(rows.where("held"))).select("label", vector_to_array("rawPrediction").alias("z"))
    temperature, likely, figures = calibrated(labels, [(labels[int(r.label)], list(r.z)) for r in scored.collect()])
    matrix, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    grams = [set(r.grams) - {"^"} for r in listed.where(~F.col("label").isin(UNKNOWN, NONE)).orderBy("template").collect()]
    table = [(gram, [float(x) for x in matrix[:, j] + (start if gram == "^" else 0)], [gram in g for g in grams]) for j, gram in enumerate(space.vocabulary)]
    parts = sorted({w for gram in space.vocabulary for w in gram.split(" ")} - {"^", "$"})
    weights = written(spark.createDataFrame(table, "gram string, w array<double>, held array<boolean>").coalesce(1), "weights")
    return Model(weights, labels, parts, [len(g) for g in grams], temperature, likely, figures)


def known_ngrams(w: str, last: str) -> Column:
    """Distinct n-grams of words of which unknown ones are null (`last`: how many there are), and the mark of the start."""
    both = f"get({w}, i) is not null and (get({w}, i + 1) is not null or i + 1 = {last})"
    pairs = F.expr(f"transform(sequence(0, greatest({last} - 1, 0)), i -> case when {both} then concat_ws(' ', get({w}, i), coalesce(get({w}, i + 1), '$')) end)")
    return F.array_distinct(F.concat(F.array_compact(F.col(w)), F.array_compact(pairs), F.array(F.lit("^"))))


def corpus_sample(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most MAX_NEGATIVES windows of about SAMPLED documents, picked by hash: what a corpus has is seldom a licence.

    Whole paragraphs are cut in windows of WINDOW_WORDS, the last one shorter, and any of them may be picked.
    """
    share = max(1, docs.count() // SAMPLED)
    picked = paragraphs(docs.where(F.pmod(F.xxhash64(key, text), F.lit(share)) == 0), key, text)
    cut = f"transform(sequence(0, greatest(size(words) - 1, 0), {WINDOW_WORDS}), i -> array_join(slice(words, i + 1, {WINDOW_WORDS}), ' '))"
    windows = picked.withColumn("words", words()).select("nth", F.explode(F.expr(cut)).alias("paragraph"))
    return windows.orderBy(F.xxhash64("paragraph", "nth"), "paragraph").limit(MAX_NEGATIVES).select("paragraph").distinct()


def licence_free(sample: DataFrame) -> DataFrame:
    """A sample of paragraphs without those that may be licences themselves, which would be wrong examples of none."""
    return sample.where(~F.col("paragraph").rlike(r"(?i)licen[cs]|copyright|permission|rights|redistribut|creative commons|\bcc\b"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: key, n_paragraphs, n_licensed, family (null: none), families, n_unknown, probability.

    A paragraph is a line with a letter or digit.  `family` is that of the
    likeliest confirmed paragraph (of equals the first) and `probability` its
    calibrated probability, `families` all of them, sorted, joined by commas.
    Without a `model` one is trained, with a sample of the documents.

    Null and empty texts have no paragraph.  Every row gives a row of its own
    text, whatever its key; other columns are ignored; an empty table gives no
    row.
    """
    spark = docs.sparkSession
    model = model or trained(spark, licence_free(corpus_sample(docs, key, text)))
    labels, families = model.labels, [f for f in model.labels if f not in (UNKNOWN, NONE)]
    # rows are told apart by key and text; equal ones share a verdict
    named = docs.select(F.col(key), F.xxhash64(F.col(key), F.col(text).cast("string")).alias("_row"), F.col(text).cast("string").alias("_text"))
    grams = paragraphs(named, "_row", "_text").select("_row", "nth", words().alias("words"))
    # an n-gram counts once in a paragraph, as in training; those with an unknown word can't be in the table and aren't made
    known = F.transform("words", lambda x: F.when(x.isin(model.parts), x))
    grams = grams.select("_row", "nth", F.size("words").alias("n"), known.alias("known"))
    each = grams.select("_row", "nth", (2 * F.col("n")).alias("total"), F.explode_outer(known_ngrams("known", "n")).alias("gram"))
    hits = each.join(F.broadcast(model.weights), "gram")  # at most MAX_FEATURES rows
    owners = [f for f, ts in TEMPLATES.items() for _ in ts]
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(labels))] + [F.count_if(F.col("held")[i]).alias(f"t{i}") for i in range(len(owners))]
    # every paragraph has one '^'; equal rows of the table have it several times and count as one
    scored = hits.groupBy("_row", "nth").agg(F.count_if(F.col("gram") == "^").alias("times"), F.max("total").alias("total"), *sums)
    logits = F.array(*(F.col(f"w{i}") / F.col("times") / model.temperature for i in range(len(labels))))
    most = lambda f: F.greatest(
        F.lit(0.0), F.lit(0.0), *(F.col(f"t{i}") / F.col("times") / F.least(F.lit(model.sizes[i]), F.greatest("total", F.lit(1))) for i, o in enumerate(owners) if o == f)
    )
    top = scored.select("_row", "nth", logits.alias("z"), F.array(*map(most, families)).alias("alike")).withColumn("top", F.array_max("z"))
    top = top.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top")))).withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    top = top.where(F.col("e")[labels.index(NONE)] < 0.5 * F.col("all"))
    own = F.array(*(F.struct((F.col("e")[labels.index(f)] / F.col("all")).alias("p"), F.lit(-k).alias("k"), F.lit(f).alias("f"), F.col("alike")[k].alias("alike")) for k, f in enumerate(families)))
    judged = top.select("_row", "nth", F.array_max(own).alias("best")).select("_row", "nth", "best.*").withColumn("ok", (F.col("p") >= model.likely) & (F.col("alike") >= CONFIRMED))
    per_row = judged.groupBy("_row").agg(
        F.count_if("ok").alias("n_licensed"),
        F.max_by("f", F.when(F.col("ok"), F.struct("p", -F.col("nth")))).alias("family"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("f")))), ",").alias("families"),
        F.count_if(~F.col("ok")).alias("n_unknown"),
        F.max(F.when(F.col("ok"), F.col("p"))).alias("probability"),
    )
    has = F.size(F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")
    none = F.lit(0).cast("long")
    return named.select(key, "_row", has.alias("n_paragraphs")).join(per_row, "_row", "left").select(
        key, "n_paragraphs", F.coalesce("n_licensed", none).alias("n_licensed"), "family", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_unknown", none).alias("n_unknown"), F.round("probability", 4).alias("probability")
    )
