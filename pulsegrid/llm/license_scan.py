"""Licence scans by a trained paragraph classifier, in DataFrame expressions only.

A unit is a line of text, or a window of 64 words of a longer one; a paragraph of
several lines (paragraphs end at lines without words) also gives its windows of 64
words that reach over a line's end, so that notices wrapped over lines are whole in
one unit. Marks of comments are no part of a unit. A multinomial logistic regression
on hashed words and word pairs gives each unit probabilities of the licence families
and of "unknown"; a unit is looked at if the families' probability passes a threshold
calibrated on held-out unknown examples. Each of its families that isn't negligible is
then confirmed by comparing the unit with the family's templates: enough of a
template's 3-word shingles must occur in it, and enough of those that no other
family's templates hold, so that a notice of a kindred licence confirms nothing. The
model and the templates are of a fixed size; nothing is shuffled.

Defined results: a null or empty text has no units and no licence; one output
row per input row, repeated rows and null ids included; a unit that names several
licences may give several families, each at most once; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import logistic
from pulsegrid.llm.common import TERM, ascii_lower, let

DIM, WINDOW = 4096, 64
#: A family below this probability is not compared with its templates.
LEAST_SHARE = 0.05
#: Marks of comments that are words (others have no letters), and what parts paragraphs: line ends with no word between them.
COMMENT = r"(?m)^[ \t]*(?:dnl|rem|REM|C)[ \t]+"
BREAK = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"

#: Notices by which the families are declared.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
#: Short names of the families.
NAMES = {"MIT": "MIT", "Apache-2.0": "Apache 2.0", "GPL": "GPL", "LGPL": "LGPL", "AGPL": "AGPL", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-4.0": "CC BY 4.0", "BSD": "BSD", "MPL-2.0": "MPL 2.0"}
#: Ways to declare a licence by its short name, alone or as one of two.
DECLARED = ["SPDX-License-Identifier: {}", "Licensed under {} or", "Licensed under the {} license", "or the {} license"]
#: A name of one word at the end of a choice needs the word before it, of two words the choice's "or".
CHOICES = {"MIT": ["2.0 or MIT"], "Apache-2.0": ["or Apache 2.0", "or Apache License, Version 2.0"], "MPL-2.0": ["or MPL 2.0"]}
TEMPLATES = {f: [*NOTICES[f], *[d.format(NAMES[f]) for d in DECLARED], *CHOICES.get(f, [])] for f in NOTICES}
FAMILIES = list(TEMPLATES)
#: Sentences that declare no licence, some of them close to it.
UNKNOWN = [
    "The driver lost the license after the accident in May.",
    "A fishing license costs twelve dollars this year.",
    "All rights reserved by the publisher of this newspaper.",
    "The committee discussed copyright law for two hours.",
    "She is a licensed electrician from the northern part of the city.",
    "The general public was free to use the garden.",
    "Version 2.0 of the game was released under great applause.",
    "The software was used in source control training at the university.",
    "Use of this product is permitted in most countries.",
    "The Apache helicopter landed under heavy rain.",
    "He studied at MIT and later released an album.",
    "The Mozilla foundation held a public meeting.",
    "Creative people share common goals and international ideas.",
    "This work is about the history of the river and the people along it.",
    "You may not enter this building without a permit.",
    "Please see the conditions on page four of the contract.",
    "Die Genehmigung wird von der Stadt erteilt und gilt ein Jahr.",
    "Das Werk ist unter dem Namen des Autors bekannt.",
    "La licence de pêche est valable pour un an.",
    "Le contrat est soumis aux conditions suivantes.",
    "La licencia de conducir se renueva cada diez años.",
    "El proyecto fue presentado bajo la lluvia.",
    "The names of the contributors are listed at the end of the book.",
    "Free admission for any person under the age of twelve.",
    "the of and to in is that it for as with on this by are be was or from at",
    "See the license file of the project for details.",
    "No license is granted by this document to anyone.",
    "The terms of the public tender were published by the ministry of the interior.",
    "You should have received a copy of the letter along with this parcel.",
    "The license plate was registered under the name of her brother.",
    "International trade under the new agreement is subject to the terms of the treaty.",
    "He got his driving license or the identity card renewed for free.",
    "Version 3 of the schedule and version 2.0 of the map may be downloaded.",
    "The above table and this figure shall be included in all reports.",
    "Sources and binary stars are observed with or without a filter.",
    "A copy of the minutes may be obtained at the town hall.",
    "The pub is licensed under the old law, or the new one, to sell wine.",
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), TERM.replace("[^", "[")), lambda w: w != "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def units_of(text: Column) -> Column:
    """Lists of word hashes: lines, and windows of paragraphs that reach over a line's end; windows overlap by half."""
    step = WINDOW // 2

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(w) - step - 1, F.lit(0)), F.lit(step))

    def cut(w: Column) -> Column:
        return F.transform(starts(w), lambda s: F.slice(w, s + 1, WINDOW))

    def across(lines: Column) -> Column:
        line_of = F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w))))

        def windows(w: Column, at: Column) -> Column:
            over = F.filter(starts(w), lambda s: F.get(at, s) != F.get(at, F.least(s + WINDOW, F.size(w)) - 1))
            return F.transform(over, lambda s: F.slice(w, s + 1, WINDOW))

        return F.when(F.size(lines) > 1, let(F.flatten(lines), lambda w: let(line_of, lambda at: windows(w, at)))).otherwise(F.array().cast("array<array<bigint>>"))

    def paragraph(lines: Column) -> Column:
        return F.concat(F.flatten(F.transform(lines, cut)), across(lines))

    parts = F.split(F.regexp_replace(text, COMMENT, ""), BREAK)
    units = F.flatten(F.transform(parts, lambda p: let(F.transform(F.split(p, "\n"), hashes_of), paragraph)))
    return F.filter(units, lambda w: F.size(w) > 0)


def features(words: Column) -> Column:
    """Distinct buckets of (hashed) words and word pairs."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(0))))
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda h: F.pmod(h, F.lit(DIM)).cast("int")))


def shingles(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(3)])))).otherwise(F.array().cast("array<bigint>"))


def training_rows() -> list[tuple[int, int, str]]:
    """(class, number of its text, text): templates whole, without their first or last third, and inside
    other sentences; unknown sentences likewise. Texts of two families stand once for each."""
    rows = []
    for k, family in enumerate([*FAMILIES, None]):
        for j, text in enumerate(TEMPLATES[family] if family else UNKNOWN):
            w = text.split()
            third = max(1, len(w) // 3)
            around = UNKNOWN[(3 * k + j) % len(UNKNOWN)]
            rows += [(k, j, text), (k, j, " ".join(w[third:]) if family is None else text), (k, j, f"{around} {text}"), (k, j, f"{text} {around}")]
            if family is None or len(w) > 12:
                rows += [(k, j, " ".join(w[:-third])), (k, j, " ".join(w[third:]))]
    for k, a in enumerate(NAMES.values()):
        for j, b in enumerate(NAMES.values()):
            if k != j:
                text = f"Dual licensed under {a} or {b}."
                rows += [(k, j, text), (j, k, text)]
    return rows


def training_table(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, {j}, '{t}')" for k, j, t in training_rows()) + " AS t(label, part, text)")


def probabilities(model: logistic.Linear, idx: Column) -> Column:
    """Softmax over families and unknown, as an array."""
    raw = logistic.margins(model, idx)

    def soft(m: Column) -> Column:
        top = F.array_max(m)
        e = F.transform(m, lambda x: F.exp(x - top))
        return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(v, lambda x: x / t)))

    return let(raw, soft)


def may_pass(model: logistic.Linear, least: float, idx: Column) -> Column:
    """False only where the families' probability is surely below ``least``, by one sum instead of one a family.

    Of the families' margins over unknown none exceeds the sum of the largest ones bucket by bucket, and the
    families' odds are at most their number times the exponential of that.
    """
    n = len(model.weights) - 1
    if least <= 0:
        return F.lit(True)
    *families, unknown = model.weights
    rel = [max(w) - u for *w, u in zip(*families, unknown, strict=True)]
    bias = max(model.intercepts[:n]) - model.intercepts[n]
    # (the slack is above what rounding of weights to six digits can add)
    return F.lit(bias) + logistic.sum_of(logistic.literal(rel), idx) * logistic.scale(idx) >= math.log(least / (1 - least) / n) - 0.01


def train(spark: SparkSession, reg: float = 0.001) -> tuple[logistic.Linear, float]:
    """The model of all rows, and the probability of the families that passes.

    The latter is calibrated on every fourth unknown sentence by a model that saw none of these (other
    rows may hold them beside a notice): above what any of them reaches, within 0.5 and 0.9.
    """
    table = training_table(spark)
    rows = table.select("label", "part", "text", features(hashes_of(F.col("text"))).alias("idx"))
    held = (F.col("label") == len(FAMILIES)) & (F.col("part") % 4 == 3)
    p = probabilities(logistic.fit(rows.where(~held), DIM, reg), F.col("idx"))
    top = rows.where(held).agg(F.max(1.0 - F.get(p, F.lit(len(FAMILIES))))).first()[0]
    return logistic.fit(rows, DIM, reg), min(0.9, max(0.5, top + 0.05))


def _triples(text: str) -> list[tuple[str, ...]]:
    w = re.findall(TERM, text.lower())
    return list(dict.fromkeys(zip(w, w[1:], w[2:], strict=False)))


def template_shingles() -> list[tuple[int, list, list]]:
    """(family, shingles, shingles that no other family's templates hold) of each template."""
    of = {f: {t for text in texts for t in _triples(text)} for f, texts in TEMPLATES.items()}
    out = []
    for k, (family, texts) in enumerate(TEMPLATES.items()):
        others = set().union(*(of[f] for f in FAMILIES if f != family))
        out += [(k, t, [x for x in t if x not in others]) for t in map(_triples, texts)]
    if not all(own for _, _, own in out):
        raise ValueError("a template must hold a shingle that no other family's templates hold")
    return out


def _literal_templates() -> Column:
    """The templates' shingles as one constant array of structs."""

    def hashes(triples: list) -> str:
        return "array(" + ", ".join("xxhash64(" + ", ".join(f"xxhash64('{w}')" for w in t) + ")" for t in triples) + ")"

    return F.expr("array(" + ", ".join(f"struct({k} AS k, {hashes(a)} AS whole, {hashes(b)} AS own)" for k, a, b in template_shingles()) + ")")


def confirmed(unit: Column, family: Column, templates: Column, share: float) -> Column:
    """Whether ``share`` of the shingles of one of the family's templates, and of its own ones, occur among the unit's."""

    def covers(t: Column) -> Column:
        return F.size(F.array_intersect(unit, t)) >= share * F.size(t)

    return F.exists(templates, lambda t: (t["k"] == family) & covers(t["own"]) & covers(t["whole"]))


def license_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: float = 0.6, model: tuple[logistic.Linear, float] | None = None) -> DataFrame:
    """Per row: id, ``n_units``, ``found``: array of (unit, family, p, confirmed) of the families that are likely in a unit."""
    linear, least = model or train(df.sparkSession)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    none = "array<struct<unit:int,family:string,p:double,confirmed:boolean>>"

    def judge(w: Column, i: Column, p: Column) -> Column:
        own_p = F.filter(F.transform(F.slice(p, 1, len(FAMILIES)), lambda x, k: F.struct(k.alias("k"), x.alias("p"))), lambda x: x["p"] >= LEAST_SHARE)

        def one(x: Column, own: Column, known: Column) -> Column:
            return F.struct(i.alias("unit"), F.element_at(names, x["k"] + 1).alias("family"), x["p"].alias("p"), confirmed(own, x["k"], known, share).alias("confirmed"))

        return let(shingles(w), lambda own: let(_literal_templates(), lambda known: F.transform(own_p, lambda x: one(x, own, known))))

    def likely(w: Column, i: Column, p: Column) -> Column:
        # (the comparison with templates is only evaluated where a licence is likely)
        return F.when(1.0 - F.get(p, F.lit(len(FAMILIES))) >= least, judge(w, i, p)).otherwise(F.array().cast(none))

    def classify(w: Column, i: Column) -> Column:
        return let(features(w), lambda idx: F.when(may_pass(linear, least, idx), let(probabilities(linear, idx), lambda p: likely(w, i, p))).otherwise(F.array().cast(none)))

    def scan(units: Column) -> Column:
        return F.struct(F.size(units).cast("long").alias("n_units"), F.flatten(F.transform(units, classify)).alias("found"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), let(units_of(text), scan).alias("s")).select(id_col, "s.n_units", "s.found")


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sure = F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"])
    listed = F.filter(F.array(*[F.lit(f) for f in FAMILIES]), lambda f: F.array_contains(sure, f))
    return found.select("doc_id", "n_units", F.size("found").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"), F.array_join(listed, ",").alias("families"))
