"""Licence scan of paragraphs with DataFrame functions only.

A multinomial logistic regression (L1) over word uni- and bigrams is fitted on
the names and identifiers of each licence family in every form of declaration, on
whole notices, on made-up near misses and on all corpus paragraphs that hold no
licence term and share no three words with a notice; what may be a declaration is
never a negative. These paragraphs are counted by the n-grams of the vocabulary that
they hold, so the fit reads one weighted row per such set; together they weigh at
most as much as ``CORPUS_PARAGRAPHS`` paragraphs, so that a large corpus doesn't
outweigh the statements. How common a word is, is counted over all paragraphs, and
licence terms always count as rare. Its few weights become literals
of a column expression. Cue words are chosen so that a paragraph without one can't
reach a family's score, and such paragraphs are passed by one pattern over the same
folded words. The score of the unknown class is raised until at most ``MISS_RATE``
of other labelled near misses and ``FALSE_RATE`` of all paragraphs without
licence terms pass for a licence, and a prediction is confirmed where the paragraph
holds at least half of the n-grams of one of the family's templates. Where a
paragraph also names other families in full, and each scores over the unknown
class, it declares those too (dual licences).
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.session import materialize

UNKNOWN = "unknown"
CORPUS_PARAGRAPHS = 2000  # so many paragraphs' weight is shared by those of the whole corpus
SETS_PER_TASK = 50_000  # n-gram sets in a task of the fit
FALSE_RATE = 0.001
MISS_RATE = 0.05
CONFIRM = 0.5
LEAST_ODDS = 1.0  # of all families together against the unknown class

# Names and identifiers of each family; digits are folded to 0.
NAMES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "MIT/X11 License", "Expat License", "MIT"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0, January 2004", "Apache Software License", "Apache 2.0 license", "Apache-2.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL version 2 or later", "GPLv3", "GPL", "GPL-3.0-only", "GPL-2.0-or-later"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPL", "LGPL-2.1-only", "LGPL-3.0-or-later"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD License", "BSD 3-Clause License", "3-clause BSD license", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0", "MPL 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC license (ISC)", "ISC"],
    "Boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
    "EPL": ["Eclipse Public License", "Eclipse Public License, Version 2.0", "EPL-2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike license", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license", "CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "CC0", "CC0-1.0"],
}
# Forms of a declaration; a name of one word declares nothing by itself.
FORMS = ["{}", "{}.", "Released under the {}.", "Licensed under the {}.", "Licensed under {}", "This project is licensed under the {}, see the LICENSE file.",
         "Distributed under the terms of the {}.", "This work is made available under the {}.", "License: {}", "SPDX-License-Identifier: {}", "# SPDX-License-Identifier: {} OR other",
         "You may use it under the {} at your option.", "see the {} file"]

# Notices by which texts declare each family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license, see the LICENSE file.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
            "Distributed under the terms of the MIT License."],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
               "This work is released under the Apache License 2.0.", "Distributed under the Apache Software License.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Released under the terms of the GNU General Public License.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the terms of the GNU Lesser General Public License.",
             "Licensed under the LGPL version 3."],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Use of this source code is governed by a BSD-style license."],
    "MPL": ["This source code form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, v. 2.0.",
            "Released under the MPL 2.0."],
    "AGPL": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under a Creative Commons Attribution license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Released under CC BY-NC 3.0 for non-commercial use."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal Public Domain Dedication."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright 2020 Example Company. All rights reserved.",
                    "This software is proprietary and confidential; unauthorized copying is prohibited."],
}
NEAR_MISSES = ["He lost his driving license in the spring.", "A fishing licence is required at the lake.", "The general public was free to visit the museum.",
               "She studied software at MIT for two years.", "The apache helicopter landed at noon.", "The new version of the play was released in May.",
               "The gnu is a large antelope of the open plain.", "The pub was licensed to sell beer under the old law.", "All rights of way are shown on the map.",
               "The bank extended its credit terms.", "The cc field of the mail was empty.", "The domain of the function is public knowledge.",
               "Copyright law changed in the last century.", "Permission to land was granted at once.", "The commons debated the bill for hours.",
               "The lesser of two evils.", "The source of the river is in the hills.", "They redistributed the food by hand.", "The work was attributed to a pupil.",
               "License", "See the LICENSE file for details.", "Copyright 2021 the authors.", "The license of the shop was renewed.", "A boost of the software sales was expected.",
               "The eclipse was public news.", "He wrote a paper at MIT, and the file was lost.", "The mozilla logo is red.", "The isc met in Rome.", "Public license fees were raised by the city.",
               "The general license fee is due in March.", "It is a simplified model in a new style.", "License: none", "This project is not licensed yet."]

# Near misses that set the threshold; none of them is fitted.
HELD_MISSES = ["Her hunting license expired last year.", "The doctor was licensed to practise in two states.", "The students at MIT built a bridge of paper.",
               "The Apache people lived on the plains.", "A version of the story was published later.", "The general told the public to stay calm.",
               "He was granted permission to leave early.", "The commons were open to all cattle of the village.", "The attribution of the painting is disputed.",
               "The public domain of the king was large.", "A table was reserved for the guests; all rights turns were closed.", "The source code was printed on paper.",
               "The foundation of the house was weak.", "The terms of the treaty were harsh.", "The software was sold in boxes.", "The restaurant lost its liquor licence.",
               "The copyright office is in the old building.", "The work is distributed over three teams.", "Free of charge, the children swam in the pool.",
               "Under the bridge a creative group of people met.",
               "The licensing office closes at noon.", "Copyright (c) 2019 John Smith", "License information", "The professor left MIT for another school.", "An Apache helicopter landed near the camp.",
               "The drink gave him a boost.", "The lunar eclipse was open to the public.", "The liquor license of the bar was revoked.", "The general public may attend."]
# Words and word pairs that may declare a licence by themselves.
TERMS = ["license", "licensed", "licenses", "copyright", "mit", "apache", "gnu", "gpl", "lgpl", "agpl", "gplv0", "lgplv0", "agplv0", "bsd", "mozilla", "mpl", "cc", "cc0", "sharealike",
         "noncommercial", "proprietary", "spdx", "creative commons", "public domain", "rights reserved", "general public", "lesser general", "affero", "isc",
         "unlicense", "boost software", "eclipse public"]

DECLARATIONS = [(f, form.format(n)) for f, some in NAMES.items() for n in some for form in FORMS if " " in n or "{}" != form.rstrip(".")]

WORD = r"[^\p{L}\p{N}+]+"


def _words(text: Column) -> Column:
    """Lower-case words, digits folded to 0, licence spelt one way."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), "licence", "license")
    return F.filter(F.split(folded, WORD), lambda w: w != "")


def _let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _ngrams(words: Column, k: int) -> Column:
    def cut(w):
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<string>"))
    return _let(words, cut)


def _among(grams: Column, some: list[str]) -> Column:
    """Those of ``grams`` that are in ``some``, each once, in the order of ``grams``."""
    return F.array_distinct(F.filter(grams, lambda g: g.isin(some)))


def _bigrams(words: Column) -> Column:
    return _ngrams(words, 2)


def _trigrams(words: Column) -> Column:
    return _ngrams(words, 3)


def _grams(text: Column) -> Column:
    return _let(_words(text), lambda w: F.array_distinct(F.concat(w, _bigrams(w))))


def paragraphs(text: Column, separator: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    lit = [F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows]
    return spark.range(1).select(F.explode(F.array(*lit)).alias("r")).select("r.*")


class Model:
    """Weights by n-gram and family, intercepts, cue words, and by family the
    templates and the names as arrays of n-grams."""

    def __init__(self, families, weights, intercepts, templates, names):
        self.families, self.weights, self.intercepts, self.templates, self.names = families, weights, intercepts, templates, names
        self.cues: set[str] = set()

    def choose_cues(self, held: dict[str, int]) -> None:
        """The words without which no family can lead the unknown class: from those
        that most paragraphs hold (``held``) on, then from the weakest, words are struck
        as long as all n-grams of the struck words together can't make up for the
        unknown class's intercept."""
        gain = {g: [max(0.0, x - w[0]) for x in w[1:]] for g, w in self.weights.items()}
        words = {w for g in gain for w in g.split()}
        power = {w: max(sum(x) for x in zip(*[gain[g] for g in gain if w in g.split()])) for w in words}
        left = [b - self.intercepts[0] for b in self.intercepts[1:]]
        struck: set[str] = set()
        for w in sorted(words, key=lambda w: (-held.get(w, 0), power[w], w)):
            more = [gain[g] for g in gain if w in g.split() and all(x in struck or x == w for x in g.split())]
            lead = [a + sum(x[k] for x in more) for k, a in enumerate(left)]
            if max(lead) < -1e-6:
                left = lead
                struck.add(w)
        self.cues = words - struck

    @property
    def cue_pattern(self) -> str:
        """Matches a lower-case text that holds a cue among its folded words."""
        cues = "|".join(sorted(re.escape(c).replace("0", r"\p{N}+").replace("license", "licen[cs]e") for c in self.cues))
        return r"(?<![\p{L}\p{N}+])(?:" + cues + r")(?![\p{L}\p{N}+])"

    def totals(self):
        """The scores, in the order of the families, as a function of the n-grams held."""
        table = F.create_map(*[x for g, w in sorted(self.weights.items()) for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in w]))])
        start = F.array(*[F.lit(float(x)) for x in self.intercepts])
        return lambda held: F.aggregate(held, start, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda u, v: u + v))

    def scored(self, rows: Column) -> Column:
        """Of an array of structs (place, p) with paragraphs p an array of structs
        (place, grams, scores), scores in the order of the families. Every step is
        one transform, so nothing is computed twice."""
        vocabulary = F.array(*[F.lit(g) for g in sorted(self.weights)])
        total = self.totals()
        rows = F.transform(rows, lambda x: F.struct(x["place"].alias("place"), _words(x["p"]).alias("words")))
        rows = F.transform(rows, lambda x: F.struct(x["place"].alias("place"), F.concat(x["words"], _bigrams(x["words"])).alias("grams")))
        rows = F.transform(rows, lambda x: F.struct(x["place"].alias("place"), x["grams"].alias("grams"), F.array_intersect(x["grams"], vocabulary).alias("held")))
        return F.transform(rows, lambda x: F.struct(x["place"].alias("place"), x["grams"].alias("grams"), total(x["held"]).alias("scores")))

    def predicted(self, rows: Column) -> Column:
        """(place, family, probability, confirmed) of the paragraphs in ``rows``: the
        best family of each, then the others that it names in full and that score
        over the unknown class, with their probability against it alone."""
        families = F.array(*[F.lit(f) for f in self.families])
        known, names = (F.array(*[F.array(*[F.array(*[F.lit(g) for g in t]) for t in some.get(f, [])]).cast("array<array<string>>") for f in self.families])
                        for some in (self.templates, self.names))

        def alike(x, k, some, share):
            return F.exists(F.element_at(some, k), lambda t: F.size(F.array_intersect(t, x["grams"])) >= share * F.size(t))

        def found(x, k, probability, confirmed):
            return F.struct(x["place"].cast("int").alias("place"), F.element_at(families, k).alias("family"), F.round(probability, 4).alias("probability"),
                            confirmed.alias("confirmed"))

        rows = F.transform(self.scored(rows), lambda x: F.struct(x["place"].alias("place"), x["grams"].alias("grams"), x["scores"].alias("scores"),
                                                                 F.array_max(x["scores"]).alias("best")))
        rows = F.transform(rows, lambda x: F.struct(
            x["place"].alias("place"), x["grams"].alias("grams"), x["scores"].alias("scores"), F.array_position(x["scores"], x["best"]).cast("int").alias("k"),
            (1 / F.aggregate(x["scores"], F.lit(0.0), lambda a, v: a + F.exp(v - x["best"]))).alias("probability")))
        # a paragraph whose best family is the unknown class declares nothing
        rows = F.filter(rows, lambda x: (x["k"] > 1) & (F.aggregate(F.slice(x["scores"], 2, len(self.families) - 1), F.lit(0.0),
                                                                    lambda a, v: a + F.exp(v - x["scores"][0])) >= LEAST_ODDS))
        others = F.sequence(F.lit(2), F.lit(len(self.families)))
        return F.flatten(F.transform(rows, lambda x: F.concat(
            F.array(found(x, x["k"], x["probability"], alike(x, x["k"], known, CONFIRM))),
            F.transform(F.filter(others, lambda k: (k != x["k"]) & (F.element_at(x["scores"], k) > x["scores"][0]) & alike(x, k, names, 1.0)),
                        lambda k: found(x, k, 1 / (1 + F.exp(x["scores"][0] - F.element_at(x["scores"], k))), F.lit(True))))))


def _every(docs: DataFrame, separator: str) -> DataFrame:
    return docs.select(F.explode(paragraphs(F.col("text").cast("string"), separator)).alias("text"))


def _holders(docs: DataFrame, separator: str, words: list[str]) -> dict[str, int]:
    """In how many paragraphs of all each of ``words`` is held; "" counts the paragraphs."""
    held = F.concat(F.array(F.lit("")), _among(_words(F.col("text")), words))
    counts = _every(docs, separator).select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r["w"]: r["n"] for r in counts.collect()}


def _negatives(docs: DataFrame, separator: str, vocabulary: list[str], triples: list[str]) -> DataFrame:
    """grams (sorted n-grams of ``vocabulary``) and n: how many of all paragraphs
    without a licence term or one of ``triples`` hold just these."""
    pairs = sorted({" ".join(t.split()[i:i + 2]) for t in triples for i in (0, 1)})

    def declares(w, b):
        term = F.exists(F.concat(w, b), lambda g: g.isin(TERMS))
        return term | (F.exists(b, lambda g: g.isin(pairs)) & F.exists(_trigrams(w), lambda g: g.isin(triples)))

    def held(w):
        return _let(_bigrams(w), lambda b: F.when(~declares(w, b), F.array_sort(_among(F.concat(w, b), vocabulary))))

    sets = _every(docs, separator).select(_let(_words(F.col("text")), held).alias("grams")).groupBy("grams").agg(F.count("*").alias("n"))
    # a null set counts what may declare a licence; dropped here, the sets are computed once
    return materialize(sets.sortWithinPartitions("grams")).where("grams is not null")


def fit_licenses(docs: DataFrame, separator: str = r"\n+", corpus: int = CORPUS_PARAGRAPHS, false_rate: float = FALSE_RATE,
                 miss_rate: float = MISS_RATE) -> Model:
    """Fits on the statements, near misses and all corpus paragraphs without licence
    terms, which together weigh as much as ``corpus`` of them if they are more; word
    frequencies and the false rate are those of all paragraphs."""
    spark = docs.sparkSession
    known = _table(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts])
    halves = known.union(known.where("length(text) > 90").select("family", F.expr("substring(text, 1, length(text) div 2)")))
    halves = halves.union(known.select("family", F.concat(F.lit("Copyright (c) 2021 the authors. "), F.col("text"))))
    halves = halves.union(_table(spark, DECLARATIONS))
    misses = _table(spark, [(UNKNOWN, t) for t in NEAR_MISSES])
    triples = sorted(r["g"] for r in known.select(F.explode(_trigrams(_words(F.col("text")))).alias("g")).distinct().collect())
    families = [UNKNOWN, *TEMPLATES]  # every family has a notice
    words = [r["g"] for r in halves.select(F.explode(_grams(F.col("text"))).alias("g")).distinct().orderBy("g").collect()]
    held = _holders(docs, separator, sorted({w for g in words for w in g.split()}))
    # common words are those that more than one in 200 paragraphs hold
    common = {w for w, n in held.items() if n > max(1, held.get("", 0) // 200)} - {"", *TERMS}
    # n-grams all of whose words are common in the corpus say nothing here
    vocabulary = [g for g in words if not all(w in common or len(w) < 2 for w in g.split())]
    negatives = _negatives(docs, separator, vocabulary, triples)
    size = negatives.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    index = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    train = halves.union(misses).select(F.element_at(index, F.col("family")).alias("label"), _grams(F.col("text")).alias("grams"),
                                        F.when(F.col("family") == UNKNOWN, 0.3).otherwise(1.0).alias("weight"))
    if size["n"]:
        train = train.union(negatives.select(F.lit(0.0), "grams", F.col("n") * F.lit(0.3 * min(1.0, corpus / size["n"]))))
    train = train.coalesce(size["sets"] // SETS_PER_TASK + 1)
    vector = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    fitted = LogisticRegression(maxIter=25, regParam=2e-4, elasticNetParam=0.5, family="multinomial", weightCol="weight", standardization=False).fit(vector.transform(materialize(train)))
    matrix, bias = fitted.coefficientMatrix.toArray(), list(fitted.interceptVector.toArray())
    while len(bias) < len(families):
        bias.append(-30.0)
    weights = {}
    for j, g in enumerate(vocabulary):
        w = [round(float(matrix[k][j]), 4) if k < len(matrix) else 0.0 for k in range(len(families))]
        if any(abs(x) > 1e-3 for x in w):
            weights[g] = w
    every = known.union(_table(spark, [(f, t) for f, some in NAMES.items() for t in (*some, *(f"SPDX-License-Identifier: {x}" for x in some if " " not in x))]))
    templates = {f: [] for f in TEMPLATES}
    for r in every.select("family", "text", _words(F.col("text")).alias("w"), F.array_distinct(_bigrams(_words(F.col("text")))).alias("b")).collect():
        templates[r["family"]].append((r["text"], sorted(r["b"]) or r["w"]))
    names = {f: [t for said, t in templates[f] if said in some] for f, some in NAMES.items()}
    # a name of one word alone confirms nothing
    model = Model(families, weights, bias, {f: [t for _, t in some if " " in t[0]] for f, some in templates.items()}, names)

    def lead(rows: DataFrame, rate: float) -> float:
        """By how much the families lead over the unknown class in all but ``rate`` of
        the ``n`` paragraphs with ``grams``, rounded up to four digits as the weights are."""
        rows = rows.select("n", _let(model.totals()(_among(F.col("grams"), sorted(weights))),
                                     lambda s: F.array_max(F.slice(s, 2, len(families) - 1)) - s[0]).alias("lead"))
        rows = rows.select("n", (F.ceil(F.col("lead") * 10_000) / 10_000).alias("lead"))
        return math.ceil((rows.agg(F.percentile("lead", F.lit(1 - rate), F.col("n")).alias("q")).first()["q"] or 0.0) * 10_000) / 10_000

    # calibrate the unknown class
    bars = [lead(_table(spark, [(UNKNOWN, t) for t in HELD_MISSES]).select(F.lit(1).alias("n"), _grams(F.col("text")).alias("grams")), miss_rate)]
    if size["n"]:
        bars.append(lead(negatives, false_rate))
    model.intercepts[0] += max(0.0, *bars)
    model.choose_cues(held)
    return model


def scan_licenses(docs: DataFrame, model: Model, separator: str = r"\n+") -> DataFrame:
    """doc_id, n_paragraphs and licenses (place, family, probability, confirmed)
    for every row. Null and empty texts have no paragraphs and an empty table gives
    an empty table; a text of any length is read whole, by one task. Of families with
    equal scores the first in the order of the model is named. Other columns than
    doc_id and text are not read; repeated rows are scanned each on their own."""
    text = F.col("text").cast("string")
    every = paragraphs(text, separator)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = F.size(every).cast("long")
    cue = model.cue_pattern
    near = F.filter(F.transform(every, lambda p, i: F.struct(i.alias("place"), p.alias("p"))), lambda x: F.lower(x["p"]).rlike(cue))
    kind = "array<struct<place:int,family:string,probability:double,confirmed:boolean>>"
    return rows.select("doc_id", n.alias("n_paragraphs"), F.when(F.lower(text).rlike(cue), model.predicted(near)).otherwise(F.array().cast(kind)).alias("licenses"))
