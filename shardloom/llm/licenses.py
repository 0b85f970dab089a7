"""Operator 2: licence scan of paragraphs by n-gram regression, confirmed against templates. DataFrame functions only.

The model (a few thousand n-grams) is fitted on the driver, from the templates below and noise, with a
fixed seed; documents are scored by a join of their paragraphs' n-grams with its weights.
"""

from __future__ import annotations

import dataclasses
import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.ftrl import Ftrl, activate

NONE, UNKNOWN = "none", "unknown"
#: Notices of well-known public licences, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 1.0 Universal public domain dedication."],
}
#: Licence-like sentences of no family above, and sentences that only share words with licences.
UNFAMILIAR = [
    "All rights reserved.",
    "All rights reserved. No part of this publication may be reproduced without written permission.",
    "This software is licensed to the customer under a commercial agreement.",
    "Use of this material is subject to the terms of the licence agreement between the parties.",
    "Licensed under the terms of the vendor's end user licence agreement.",
    "Copyright 2020 by the authors. Licensed for internal use only.",
    "Licensed under a custom licence; ask the owner for permission to copy or distribute.",
    "Released under our own community license, version 1.",
    "This document is provided without warranty of any kind.",
]
PLAIN = [
    "She renewed her driver's license before the trip to the coast.",
    "The council granted a fishing licence for the river in the spring.",
    "He had no permission to enter the building without his badge.",
    "The warranty covers the engine for five years or a hundred thousand miles.",
    "The law on copyright was debated in the house for three days.",
    "They apply a general rule in version 3 of the public plan for the work.",
    "Free software and public money was the subject of the talk.",
    "The Apache helicopter landed near MIT in Cambridge.",
]
N = 3  # n-grams of one to N words
CERTAIN = 0.6  # least probability of a family
COVERED = 0.6  # least share of a template's bigrams that confirms it
BITS = 63  # bits of a number that say which bigrams of templates a paragraph has
WORD = r"[a-z0-9][a-z0-9.+]*[a-z0-9]|[a-z0-9]"


def word_list(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(words: list[str], top: int = N) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in range(1, top + 1) for i in range(len(words) - n + 1)})


@dataclasses.dataclass(frozen=True)
class LicenceModel:
    names: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float


@functools.lru_cache(maxsize=1)
def fit_licences(seed: int = 7, copies: int = 12, epochs: int = 6) -> LicenceModel:
    """Fits on templates and other sentences, each with words dropped, put in and cut off at either end.

    A fifth of the examples is held back; on it the temperature is chosen that gives the least log loss.
    """
    rnd = random.Random(seed)
    noise = [w for t in (*PLAIN, *UNFAMILIAR) for w in word_list(t)]
    names = [*sorted(TEMPLATES), UNKNOWN, NONE]

    def variant(words: list[str]) -> list[str]:
        out = [w for w in words if rnd.random() > 0.06]
        for _ in range(rnd.randint(0, 1 + len(words) // 8)):
            out.insert(rnd.randint(0, len(out)), "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 9))))
        if rnd.random() < 0.3:
            out = [*rnd.sample(noise, 3), *out, *rnd.sample(noise, 3)]
        return out

    rows = []
    for name, sentences in [*TEMPLATES.items(), (UNKNOWN, UNFAMILIAR), (NONE, PLAIN)]:
        for s in sentences:
            w = word_list(s)
            rows += [(ngrams(w), name)] * 2 + [(ngrams(variant(w)), name) for _ in range(copies)]
    rows += [(ngrams([rnd.choice(noise) for _ in range(rnd.randint(1, 25))]), NONE) for _ in range(150)]
    rnd.shuffle(rows)
    vocabulary = {g: i for i, g in enumerate(sorted({g for r, _ in rows for g in r}))}
    model = Ftrl(len(vocabulary) + 1, len(names), alpha=0.3, beta=1.0, l1=0.05, l2=0.1)
    examples = [(np.array([vocabulary[g] for g in r] + [len(vocabulary)]), np.ones(len(r) + 1), np.eye(len(names))[names.index(n)]) for r, n in rows]
    held = examples[::5]
    for _ in range(epochs):
        for i, e in enumerate(examples):
            if i % 5:
                model.learn(*e)
    w = model.weights()
    z, y = np.array([x @ w[at] for at, x, _ in held]), np.array([np.argmax(t) for _, _, t in held])
    loss = lambda t: -np.log(np.maximum(activate(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    if names[int(np.argmax(w[len(vocabulary)]))] != NONE:
        raise ValueError("the model takes a text without known n-grams for a notice")
    return LicenceModel(names, {g: w[i] for g, i in vocabulary.items() if np.any(w[i])}, w[len(vocabulary)], temperature)


def _of(hashes: Column, more: Column, n: int) -> Column:
    """Hashes of the n-grams, from those of the (n - 1)-grams and of the words."""
    size = F.greatest(F.size(more) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(hashes, 1, size), F.slice(more, n, size), lambda a, b: F.xxhash64(a, b))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _words(line: Column) -> Column:
    return _hashes(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def _hash_of(gram: Column, n: Column) -> Column:
    """The hash of one n-gram of n words, given as text."""
    one = _hashes(F.split(gram, " "))
    two = _of(one, one, 2)
    return F.when(n == 1, one[0]).when(n == 2, two[0]).otherwise(_of(two, one, 3)[0])


def _needed() -> list[str]:
    """Bigrams of which a text has at least one if it has COVERED of any template's: of n bigrams, k needed, n - k + 1 do.

    Of each template the longest are taken, as they are likely to be rare; which ones changes the cost, not the results.
    """
    out = set()
    for t in (t for all_t in TEMPLATES.values() for t in all_t):
        grams = sorted(_bigrams(word_list(t)), key=lambda g: (-len(g), g))
        k = next(k for k in range(len(grams) + 1) if k / len(grams) >= COVERED)
        out.update(grams[: len(grams) - k + 1])
    return sorted(out)


def licence_findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per paragraph that is a licence notice: (key, paragraph, family, score, template, coverage, confirmed).

    A paragraph is a line, or several lines between blank ones: these are scored as a whole too, which gives a
    row only if it confirms a family that none of the lines alone does (a notice of wrapped lines); marks of
    comments are no words. `paragraph` is the number of the (first) line from 0. Every paragraph of every length
    is scored, but for lines taken together that lack so many bigrams of each template that none can be
    confirmed; an empty table gives no rows.
    `score` is the calibrated chance of `family`. A family stands if its chance is at least CERTAIN and
    one of its templates has at least COVERED of its bigrams in the paragraph; `template` is the number
    of the best one. A likely notice for which either fails is of family `unknown`. Null and empty texts
    give no rows; of rows with equal key and text each gives its own. N-grams are told apart by 64-bit hashes.
    """
    spark, model = docs.sparkSession, fit_licences()
    # a line's text is left behind once its words are hashed; no shuffle comes before that, so numbers can tell rows apart
    row = ("id", "k", "block", "paragraph", "whole")
    pieces = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("k"), F.split(text, r"\n[ \t\r]*(?=\n)").alias("ps")).withColumn("sizes", F.expr(r"transform(ps, x -> size(split(x, '\n')))"))
    starts = F.expr("aggregate(sizes, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))")
    pieces = pieces.withColumn("starts", starts).select("id", "k", F.explode_outer(F.expr("transform(ps, (x, i) -> struct(starts[i] as block, x as piece))")).alias("p")).select("id", "k", "p.*")
    needed = spark.createDataFrame([(g,) for g in _needed()], "gram string").select(_hash_of(F.col("gram"), F.lit(2)))
    needed = F.array(*(F.lit(r[0]) for r in needed.collect()))
    several = F.expr(r"trim(piece) like '%\n%'")
    first = F.col("block") + F.expr(r"size(split(regexp_extract(piece, '^\\s*', 0), '\n')) - 1")
    words = pieces.select("id", "k", "block", several.alias("several"), first.alias("first"), F.transform(F.split("piece", "\n"), _words).alias("ws"))
    words = words.withColumn("all", F.when(F.col("several"), F.flatten("ws")))
    whole = F.when(F.arrays_overlap(_of(F.col("all"), F.col("all"), 2), needed), F.array(F.struct(F.col("first").alias("paragraph"), F.lit(True).alias("whole"), F.col("all").alias("ws"))))
    alone = F.transform("ws", lambda x, i: F.struct((F.col("block") + i).alias("paragraph"), F.lit(False).alias("whole"), x.alias("ws")))
    lines = words.select("id", "k", "block", F.explode_outer(F.concat(alone, F.coalesce(whole, F.array().cast("array<struct<paragraph:int,whole:boolean,ws:array<bigint>>>")))).alias("r")).select("id", "k", "block", "r.*")
    pairs = lines.where(F.size("ws") > 0).withColumn("pairs", _of(F.col("ws"), F.col("ws"), 2))
    grams = pairs.select(*row, F.explode_outer(F.array_distinct(F.concat("ws", "pairs", _of(F.col("pairs"), F.col("ws"), 3)))).alias("gram"))
    # which bigrams of templates a paragraph has is kept as bits
    classes = range(len(model.names))
    marked = {g: i for i, g in enumerate(sorted({g for all_t in TEMPLATES.values() for t in all_t for g in _bigrams(word_list(t))}))}
    masks = range(len(marked) // BITS + 1)
    bits = lambda gs: [sum(1 << marked[g] % BITS for g in gs if marked.get(g, -1) // BITS == j) for j in masks]
    zero = np.zeros(len(model.names))
    known = [(g, g.count(" ") + 1, [float(x) for x in model.weights.get(g, zero)], bits([g])) for g in sorted(model.weights.keys() | marked.keys())]
    weights = spark.createDataFrame(known, "known string, n int, w array<double>, bits array<bigint>").select(_hash_of(F.col("known"), F.col("n")).alias("gram"), "w", "bits")
    # a paragraph without any n-gram of the model is of the class with the greatest bias, `none`
    hits = grams.join(F.broadcast(weights), "gram")
    logits = hits.groupBy(*row).agg(
        *(F.bit_or(F.col("bits")[j]).alias(f"b{j}") for j in masks),
        *(((F.sum(F.col("w")[c]) + float(model.bias[c])) / model.temperature).alias(f"z{c}") for c in classes),
    )
    top = F.greatest(*(F.col(f"z{c}") for c in classes))
    total = functools.reduce(lambda a, b: a + b, [F.exp(F.col(f"z{c}") - top) for c in classes])
    best = functools.reduce(lambda acc, c: acc.when(F.col(f"z{c}") == top, F.lit(model.names[c])), classes, F)
    guess = logits.select(*row, *(f"b{j}" for j in masks), best.alias("guess"), F.round(1 / total, 6).alias("score")).where(F.col("guess") != NONE)

    def share(sentence: str) -> Column:
        grams = _bigrams(word_list(sentence))
        return functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"b{j}").bitwiseAND(F.lit(b))) for j, b in enumerate(bits(grams)) if b]) / F.lit(len(grams))

    shares = functools.reduce(lambda acc, f: acc.when(F.col("guess") == f, F.array_max(F.array(*(F.struct(share(t).alias("share"), F.lit(-i).alias("minus")) for i, t in enumerate(TEMPLATES[f]))))), TEMPLATES, F)
    covered = guess.select(*row, "guess", "score", shares.alias("t")).withColumn("share", F.coalesce("t.share", F.lit(0.0)))
    stands = (F.col("guess") != UNKNOWN) & (F.col("score") >= CERTAIN) & (F.col("share") >= COVERED)
    named = F.collect_set(F.when(~F.col("whole") & stands, F.col("guess"))).over(Window.partitionBy("id", "block"))
    covered = covered.withColumn("named", named).where(~F.col("whole") | (stands & ~F.array_contains("named", F.col("guess"))))
    return covered.select(
        F.col("k").alias(key),
        "paragraph",
        F.when(stands, F.col("guess")).otherwise(UNKNOWN).alias("family"),
        "score",
        F.when(stands, -F.col("t.minus")).alias("template"),
        F.round("share", 6).alias("coverage"),
        stands.alias("confirmed"),
    )


def _bigrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
