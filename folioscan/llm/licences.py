"""Operator 7, licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line; its features are the word pairs and triples (letters and digits, in lower
case) that some template has. A softmax regression with a class for each licence family and one for
"unknown" is fitted by Spark's own multinomial logistic regression over the templates, their parts,
and a sample of the corpus's own paragraphs as unknown (at most FIT_ROWS, an expected number, chosen
by hash). The unknown class is calibrated: of CALIBRATIONS offsets, the one with the least log-loss
on the half of the variants and of the corpus's paragraphs that training didn't see.

A paragraph that is likelier some family than unknown is compared with that family's templates, and
confirmed if CONFIRM_PERCENT % of the template's word pairs and triples, or of its own, are shared.

Null and empty texts have no paragraphs; null ids are returned as they are; repeated rows are scanned
each. Long texts and paragraphs are cut into rows of word pairs, which are summed. Ties go to the
family, then to the template, that is listed first; the sample is the same on every run. No rows: no
rows, and training goes by the templates alone. Further columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, written

FIT_ROWS, FIT_PARTITIONS, STEPS, RIDGE, CONFIRM_PERCENT = 4_000, 2, 40, 1e-3, 55
CALIBRATIONS = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
UNKNOWN = "unknown"

#: Public licence notices by family. Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "Released under the Unlicense."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("eupl", "Licensed under the European Union Public Licence, version 1.2 or later."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License."),
    ("odbl", "This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License."),
    ("artistic", "This program is distributed under the terms of the Artistic License 2.0."),
    ("afl", "Licensed under the Academic Free License version 3.0."),
    ("ms-pl", "This software is licensed under the Microsoft Public License."),
    ("psf", "Licensed under the Python Software Foundation License Version 2."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
]
#: Sentences that speak of licences and grant none. Fixed values.
UNKNOWN_TEMPLATES = [
    "The licence was revoked last year.",
    "She got her driving license in May.",
    "All rights reserved.",
    "The terms of the contract were not published by the company.",
    "This work is a study of public law.",
    "You can use this file as you like.",
    "A software license may cost more than the machine it runs on.",
    "The public library is open to any person free of charge.",
    "He works for a free software foundation in Boston.",
    "Any later version of the story was lost.",
    "The European Union published its report in public last week.",
    "Their band was released from its contract under the old terms.",
    "Permission was granted to use the hall for any purpose.",
    "The software is provided by the school, and the authors are its pupils.",
]


def grams_of(line: Column) -> Column:
    """Distinct word pairs and triples."""
    words = F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    triples = F.when(F.size(words) > 2, F.zip_with(F.slice(words, 1, F.size(words) - 2), F.zip_with(F.slice(words, 2, F.size(words) - 2), F.slice(words, 3, F.size(words) - 2), lambda a, b: F.concat_ws(" ", a, b)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, triples))


def gram_rows(lines: DataFrame) -> DataFrame:
    """doc_id, paragraph, n, gram: each pair and triple of each line where it stands; n is their number.

    Words are cut once a line, and all that follows stays in generated code up to the join.
    """
    words = lines.select("doc_id", "paragraph", F.array_remove(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), "").alias("words"))
    last = F.size("words") - 2
    placed = words.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    one, two, three = (F.get("words", F.col("at") + k) for k in range(3))
    pair = F.concat(one, F.lit(" "), two)
    grams = F.stack(F.lit(2), pair, F.concat(pair, F.lit(" "), three))
    return placed.select("doc_id", "paragraph", (2 * F.size("words") - 3).alias("n"), grams.alias("gram")).filter("gram IS NOT NULL")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("paragraph", "line"))


def _examples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """id, family, test, grams"""
    rows = []
    for k, (family, text) in enumerate([*TEMPLATES, *((UNKNOWN, t) for t in UNKNOWN_TEMPLATES)]):
        words = text.split()
        rows.append((f"t{k}", family, text))
        if len(words) > 12:
            third = len(words) // 3
            rows += [(f"t{k}.{j}", family, " ".join(words[j * third : (j + 2) * third])) for j in range(2)]
        rows.append((f"t{k}+", family, f"Project notes. {text} See the file for details."))
    made = spark.createDataFrame(rows, "id string, family string, line string")
    total = max(1, docs.count())
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / 10 / total)))
    # Of the corpus, paragraphs without the word itself, a few of each chosen document: surely unknown.
    own = paragraphs(chosen).filter(~F.lower("line").rlike("licen[cs]e") & (F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(100)) < 50)).select(F.concat_ws(":", "doc_id", "paragraph").alias("id"), F.lit(UNKNOWN).alias("family"), "line")
    both = made.unionByName(own.orderBy(F.xxhash64("id", "line"), "id", "line").limit(FIT_ROWS))
    # Whole templates are always learnt from; of their variants and of the corpus, one half calibrates.
    half = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)) == 1) & ~F.col("id").rlike("^t[0-9]+$")
    return both.select("id", "family", half.alias("test"), grams_of(F.col("line")).alias("grams"))


class Classifier:
    """Weights by gram and family, and what templates have each gram."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], templates: dict[str, list[int]], sizes: list[int]) -> None:
        self.families, self.weights, self.bias, self.templates, self.sizes = families, weights, bias, templates, sizes


def _numbers(values: list[float]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<double>")


def train(docs: DataFrame) -> Classifier:
    spark = docs.sparkSession
    families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
    listed = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEMPLATES)], "template int, line string").select("template", F.explode(grams_of(F.col("line"))).alias("gram")).collect()
    templates: dict[str, list[int]] = {}
    for r in listed:
        templates.setdefault(r["gram"], []).append(r["template"])
    sizes = [sum(1 for r in listed if r["template"] == k) for k in range(len(TEMPLATES))]
    # One fit in the JVM over rows bounded by FIT_ROWS, read once into few partitions.
    vectors = CountVectorizerModel.from_vocabulary(sorted(templates), inputCol="grams", outputCol="features", binary=True)
    examples = vectors.transform(written(_examples(spark, docs), "examples").coalesce(FIT_PARTITIONS))
    names = F.array(*map(F.lit, families))
    # Unknown paragraphs are many, so each class weighs the same.
    sums = {r["family"]: r["n"] for r in examples.filter("NOT test").groupBy("family").agg(F.count("*").alias("n")).collect()}
    n = sum(sums.values())
    share = F.coalesce(*(F.when(F.col("family") == f, n / (len(families) * sums[f])) for f in families))
    examples = examples.withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double")).withColumn("share", share)
    fitted = LogisticRegression(family="multinomial", weightCol="share", maxIter=STEPS, regParam=RIDGE, standardization=False).fit(examples.filter("NOT test"))
    weights = {g: list(map(float, w)) for g, w in zip(vectors.vocabulary, fitted.coefficientMatrix.toArray().T, strict=True)}
    bias = list(map(float, fitted.interceptVector))
    # Sums of odds are made once a row; an offset of the unknown class then changes one term of them.
    scored = fitted.transform(examples.filter("test")).select("family", "share", "label", vector_to_array("rawPrediction").alias("s")).withColumn("top", F.array_max("s"))
    known = F.aggregate(F.slice("s", 1, len(families) - 1), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.select("family", "share", "top", known.alias("known"), F.get("s", F.lit(len(families) - 1)).alias("none"), F.get("s", F.col("label").cast("int")).alias("own"))
    losses = []
    for k, offset in enumerate(CALIBRATIONS):
        own = F.col("own") + F.when(F.col("family") == UNKNOWN, offset).otherwise(0.0) - F.col("top")
        log_p = own - F.log(F.col("known") + F.exp(F.col("none") + offset - F.col("top")))
        losses.append(F.sum(-F.greatest(log_p, F.lit(math.log(1e-9))) * F.col("share")).alias(f"l{k}"))
    row = scored.agg(*losses).first()
    best = min(range(len(CALIBRATIONS)), key=lambda k: row[f"l{k}"] if row[f"l{k}"] is not None else math.inf)
    bias[-1] += CALIBRATIONS[best]
    return Classifier(families, weights, bias, templates, sizes)


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, template, overlap: one row for each confirmed licence paragraph."""
    spark = docs.sparkSession
    model = model or train(docs.select("doc_id", "text"))
    n = len(model.families)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # rows that share an id are told apart
    lines = paragraphs(numbered.select(F.struct("row", "doc_id").alias("doc_id"), "text"))
    # Word pairs and triples as numbers, each once a paragraph; then their weights and templates.
    known = spark.createDataFrame([(g, k) for k, g in enumerate(sorted(model.weights))], "gram string, k int")
    weights = spark.createDataFrame([(k, model.weights[g], model.templates[g]) for k, g in enumerate(sorted(model.weights))], "k int, w array<double>, templates array<int>")
    own = gram_rows(lines).join(F.broadcast(known), "gram").select("doc_id", "paragraph", "n", "k").distinct()
    summed = own.join(F.broadcast(weights), "k").groupBy("doc_id", "paragraph", "n").agg(F.array(*(F.sum(F.col("w")[c]) for c in range(n))).alias("s"), F.collect_list("templates").alias("ts"))
    # The likeliest family is that of the largest sum, so shares are only made for paragraphs that stay.
    judged = summed.withColumn("s", F.zip_with("s", _numbers(model.bias), lambda x, b: x + b)).withColumn("top", F.array_max("s"))
    names = F.array(*map(F.lit, model.families))
    judged = judged.withColumn("family", F.element_at(names, F.array_position("s", F.col("top")).cast("int"))).filter(F.col("family") != UNKNOWN)
    judged = judged.withColumn("probability", 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    # The share of each template's grams, or of the paragraph's own, for templates of that family.
    sizes, families = F.array(*map(F.lit, model.sizes)), F.array(*(F.lit(f) for f, _ in TEMPLATES))
    shared = lambda k: F.size(F.filter("ts", lambda x: F.array_contains(x, k)))
    overlaps = F.transform(sizes, lambda size, k: F.when(F.get(families, k) == F.col("family"), 100.0 * shared(k) / F.least(F.col("n"), size)).otherwise(-1.0))
    judged = judged.withColumn("o", overlaps).withColumn("overlap", F.array_max("o")).filter(F.col("overlap") >= CONFIRM_PERCENT)
    return judged.select("doc_id.doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), (F.array_position("o", F.col("overlap")) - 1).cast("int").alias("template"), F.round("overlap", 3).alias("overlap"))
