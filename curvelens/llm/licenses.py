"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are lines. A multinomial logistic regression on sparse word one- and two-grams tells licence
families from ordinary text; it learns from the notice templates and from paragraphs of the corpus that
equal a template or resemble none. A temperature fitted on held-out paragraphs calibrates it, and an
unsure paragraph is ``unknown``. A family counts as confirmed if the paragraph resembles a template of it and
has the template's version numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelens.llm.common import ascii_lower, body, let, staged

#: Usual wording of notices, by SPDX family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Marks of licence talk, for paragraphs that a person would have to read.
TALK = ["licence", "license", "licensed", "copyright"]
FAMILIES = sorted(TEMPLATES)
OTHER = "none"

#: Paragraphs of the corpus to learn from, for each family and for ordinary text; n-grams of an ordinary one; n-grams kept.
FAMILY_ROWS, OTHER_ROWS, ROW_GRAMS, FEATURES = 300, 6_000, 400, 2_000
#: Share of ordinary paragraphs in which a feature may occur.
COMMON = 0.001
CONFIDENT, ALIKE = 0.5, 0.6
STEPS, RIDGE = 400, 1e-4
APART = r"\x20\x09-\x0D.,;:()\""
TOKEN = f"[^{APART}]+"


def _tokens(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(TOKEN, lower)


def _grams(tokens: list[str]) -> set[str]:
    return {*tokens, *map(" ".join, zip(tokens, tokens[1:]))}


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(TOKEN), F.lit(0))


def grams(line: Column) -> Column:
    """Distinct one- and two-grams."""

    def of(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
        return F.array_distinct(F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(F.array().cast("array<string>"))))

    return let(tokens(line), of)


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray  # features + bias, by class; the last class is ordinary text
    temperature: float

    @property
    def margins(self) -> np.ndarray:
        return (self.weights[:, :-1] - self.weights[:, -1:]) / self.temperature

    def telling(self) -> list[str]:
        """n-grams one of which every paragraph has that can reach a family: those with a word feature in
        them are left to the word. Without any feature a paragraph has the bias alone, below 0."""
        return sorted(g for g in self.features if " " not in g or not any(w in self.features for w in g.split(" ")))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[list[str], int]], held: list[tuple[list[str], int]]) -> Model:
    """Multinomial logistic regression, and the temperature that fits held-out rows best.

    Features are the n-grams of the families that are rare in ordinary text.
    """
    seen = Counter(g for x, y in rows if y < len(FAMILIES) for g in set(x))
    plain = Counter(g for x, y in rows if y == len(FAMILIES) for g in set(x))
    most = COMMON * sum(y == len(FAMILIES) for _, y in rows)
    kept = sorted((g for g in seen if plain[g] <= most), key=lambda g: (-seen[g], g))[:FEATURES]
    features = {g: i for i, g in enumerate(kept)}

    def matrix(rows):
        x = np.zeros((len(rows), len(features) + 1), np.float32)
        x[:, -1] = 1
        for i, (found, _) in enumerate(rows):
            x[i, [features[g] for g in found if g in features]] = 1
        return x, np.eye(len(FAMILIES) + 1, dtype=np.float32)[[y for _, y in rows]]

    x, y = matrix(rows)
    share = 1 / np.maximum(y.sum(axis=0), 1)
    per_row = (y @ share)[:, None] / (share > 0).sum()  # every class weighs alike
    w, ahead = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros((x.shape[1], y.shape[1]), np.float32)
    rate = 2.0 / float((x**2).sum(axis=1).max())
    for k in range(STEPS):
        slope = x.T @ ((_softmax(x @ ahead) - y) * per_row) * len(FAMILIES) + RIDGE * ahead
        new = ahead - rate * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    z, t = matrix(held or rows)
    loss = {c: -float(np.log((_softmax(z @ w / c) * t).sum(axis=1) + 1e-12).mean()) for c in (0.5, 0.7, 1.0, 1.4, 2.0)}
    return Model(features, w, min(loss, key=lambda c: (loss[c], c)))


def _similarity(found: Column, family: str) -> Column:
    """Largest Jaccard similarity of a paragraph's n-grams to the family's templates.

    A template counts only if all its numbers stand in the paragraph: another version is another licence.
    """
    alike = []
    for t in TEMPLATES[family]:
        whole, numbers = sorted(_grams(_tokens(t))), sorted({w for w in _tokens(t) if w[0].isdigit()})
        shared = F.size(F.array_intersect(found, F.array(*map(F.lit, whole))))
        similarity = shared / (F.size(found) + len(whole) - shared)
        for n in numbers:
            similarity = F.when(F.array_contains(found, n), similarity).otherwise(F.lit(0.0))
        alike.append(similarity)
    return F.greatest(*alike) if len(alike) > 1 else alike[0]


def paragraphs(docs: DataFrame) -> DataFrame:
    """__row, paragraph (from 0) and __line of every line that is not empty."""
    keyed = docs.select(_row().alias("__row"), body().alias("__t"))
    return keyed.select("__row", F.posexplode(F.split("__t", "\n")).alias("paragraph", "__line")).where("__line <> ''")


def _has(line: Column, marks: list[str]) -> Column:
    """Whether a token of the line begins with one of the n-grams, A-Z in either case."""
    gap = "[" + APART + "]+"
    found = "|".join(gap.join(map(re.escape, w.split(" "))) for w in marks)
    return line.rlike(f"(?i)(?<![^{APART}])(?:{found})") if marks else F.lit(False)


def _drawn(found: Column) -> Column:
    """At most ROW_GRAMS n-grams, those of the smallest hashes."""
    hashed = F.array_sort(F.transform(found, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    return F.transform(F.slice(hashed, 1, ROW_GRAMS), lambda x: x["g"])


def train(docs: DataFrame) -> Model:
    """A model from the templates and bounded samples of the corpus, those of the smallest hashes."""
    lines = paragraphs(docs)
    longest = sorted({max(_tokens(t), key=len) for ts in TEMPLATES.values() for t in ts})
    like = staged(lines.where(_has(F.col("__line"), longest)).select("__line").distinct(), "licence-like")
    near = staged(like.withColumn("__grams", grams(F.col("__line"))), "licence-grams")
    alike = F.array(*[F.struct(_similarity(F.col("__grams"), f).alias("s"), F.lit(i).alias("f")) for i, f in enumerate(FAMILIES)])
    near = near.withColumn("__best", F.array_max(alike)).where("__best.s >= 0.9").select("__line", "__grams", F.col("__best.f").alias("y"))
    rank = Window.partitionBy("y").orderBy(F.xxhash64("__line"), "__line")
    found = near.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= FAMILY_ROWS)
    draw = F.xxhash64("__line", "__row", "paragraph")
    plain = lines.where(~_has(F.col("__line"), TALK)).orderBy(draw, "__line").limit(OTHER_ROWS).select("__line").distinct()
    plain = staged(plain, "ordinary-lines")
    held = F.pmod(F.xxhash64("__line", F.lit("fold")), F.lit(5)) == 0
    rows = found.select("__grams", "y", held.alias("held")).unionByName(
        plain.select(_drawn(grams(F.col("__line"))).alias("__grams"), F.lit(len(FAMILIES)).alias("y"), held.alias("held"))
    ).collect()
    own = [(sorted(_grams(_tokens(t))), i) for i, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    return fit(own + [(r["__grams"], r.y) for r in rows if not r.held], [(r["__grams"], r.y) for r in rows if r.held])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph, family, confidence, similarity, confirmed of every notice.

    ``family`` is ``unknown`` where the model is unsure, or sure but not confirmed by a template.

    * Null and empty texts have no paragraphs. A document may have several notices.
    * Repeated rows report alike, each once; null ids report like others. Extra columns are ignored.
    """
    ids = docs.select("doc_id", _row().alias("__row"))
    return ids.join(_notices(docs, model or train(docs)), "__row").drop("__row")


def _row() -> Column:
    return F.xxhash64("doc_id", body())


def _notices(docs: DataFrame, model: Model) -> DataFrame:
    """``scan`` with the key of a row in the place of its id, staged."""
    spark, margins = docs.sparkSession, model.margins
    marks = sorted({*model.telling(), *TALK})
    lines = paragraphs(docs)
    if margins[-1].max() < 0:
        lines = lines.where(_has(F.col("__line"), marks))
    hit = staged(lines.distinct(), "licence-lines")
    found = hit.withColumn("__grams", grams(F.col("__line")))
    talk = F.arrays_overlap(tokens(F.col("__line")), F.array(*map(F.lit, TALK)))
    weights = spark.createDataFrame([(g, [float(v) for v in margins[i]]) for g, i in model.features.items()], "__g string, __w array<double>")
    each = found.select("__row", "paragraph", F.explode("__grams").alias("__g")).join(F.broadcast(weights), "__g")
    sums = each.groupBy("__row", "paragraph").agg(*[F.sum(F.get("__w", F.lit(i))).alias(f"__z{i}") for i in range(len(FAMILIES))])
    scored = hit.join(sums, ["__row", "paragraph"], "left")
    z = [F.coalesce(F.col(f"__z{i}"), F.lit(0.0)) + float(margins[-1, i]) for i in range(len(FAMILIES))]
    top = F.greatest(*z, F.lit(0.0))
    mass = sum((F.exp(v - top) for v in z), F.exp(-top))
    best = F.array_max(F.array(*[F.struct(v.alias("z"), F.lit(i).alias("i")) for i, v in enumerate(z)]))
    scored = scored.withColumns({"__best": best, "__p": F.exp(F.greatest(*z) - top) / mass})
    scored = scored.where((F.col("__p") >= CONFIDENT) | talk).withColumn("__grams", grams(F.col("__line")))
    near = reduce(lambda c, i: c.when(F.col("__best.i") == i, _similarity(F.col("__grams"), FAMILIES[i])), range(len(FAMILIES)), F.when(F.lit(False), 0.0))
    scored = scored.withColumn("similarity", F.round(near, 9))
    confirmed = (F.col("__p") >= CONFIDENT) & (F.col("similarity") >= ALIKE)
    family = F.when(confirmed, F.get(F.array(*map(F.lit, FAMILIES)), F.col("__best.i"))).otherwise(F.lit("unknown"))
    notices = scored.select("__row", "paragraph", family.alias("family"), F.round("__p", 6).alias("confidence"), "similarity", confirmed.alias("confirmed"))
    return staged(notices, "notices")


def document_licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document with its notices: doc_id, n_notices, families (sorted, distinct) and first_paragraph.

    Documents without a notice have 0, an empty list and null. Rows of one doc_id are one document; rows without an
    id are documents of their own, those of equal texts one.
    """
    notices = _notices(docs, model or train(docs))
    ids = docs.select("doc_id", _row().alias("__row")).distinct()
    own = F.when(F.col("doc_id").isNull(), F.col("__row")).alias("__own")
    of = ids.join(notices, "__row").select("doc_id", own, "paragraph", "family").distinct()
    every = ids.select("doc_id", own, F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("string").alias("family"))
    return every.unionByName(of).groupBy("doc_id", "__own").agg(
        F.count("paragraph").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.min("paragraph").alias("first_paragraph"),
    ).drop("__own")
