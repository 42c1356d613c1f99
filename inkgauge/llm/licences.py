"""Licence scans: a trained paragraph classifier with template comparison.

Paragraphs are cut at blank lines, without comment marks. Each is read at three widths: its lines cut at
sentence ends, its wrapped sentences joined, and as a whole or, beyond WINDOW words, in windows that
overlap by more words than any template has. Units with an anchor word are classified; others lack
too much of every template to be confirmed, so they are unknown. Features are word 1- to 3-grams, present or absent, of unit length. A
multinomial logistic regression over the licence families and an unknown class is fitted by
accelerated gradient steps, each a DataFrame aggregation over the training units: variants
of the templates (every other word drop of a few seeds) against all units of the corpus that are scored, but for
those of paragraphs that a template confirms, and prose that only talks about licences. A fifth of the unknown
units is held out, and the threshold on a family's probability lies above what NULL_QUANTILE of all of
these reach. A prediction stands only if the paragraph also contains CONFIRM of the words and bigrams of one
of the family's templates.

Everything is DataFrame and SQL functions. Grams that no template or prose has have no weight, so
weights don't grow with the corpus and are broadcast. Units with an anchor word are exploded to grams and summed by paragraph.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.llm.common import fresh, stage, table, text_of

#: Short notices of each family, as projects print them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is distributed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v3 or later.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the above copyright notice is retained.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "This work has been dedicated to the public domain under CC0 1.0.",
        "Released into the public domain under the CC0 1.0 Universal license.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without written permission; all rights reserved.",
    ),
}
#: Prose about licences, rights and copyright that grants nothing.
PROSE = (
    "His driving license was suspended for three months.",
    "The driver showed her licence at the border.",
    "The council discussed new licence fees for restaurants.",
    "A fishing license can be bought at the harbour office.",
    "Copyright law was reformed in the nineteenth century.",
    "The lecture explained what a software license is.",
    "She reserved all the seats in the second row.",
    "The rooms on the upper floor are reserved for staff.",
    "Civil rights were debated in parliament again.",
    "The band released its first record in the spring.",
    "The public domain is a concept of copyright law.",
    "He writes about the Apache helicopter and its crew.",
    "Students from MIT released a report on licensing.",
    "The reserve is open to the general public on Sundays.",
    "Version 2.0 of the report is under review.",
    "The work is under way and will be finished in May.",
)
CLASSES = ("unknown", *TEMPLATES)
STEPS = 20
RATE = 20.0
MOMENTUM = 0.9
L2 = 1e-5
#: The gram that stands for the bias.
BIAS = -1
VARIANTS = 6
CONFIRM = 0.75
NULL_QUANTILE = 0.999
LEAST_PROBABILITY = 0.5
#: Sentence ends in a paragraph whose lines may be wrapped.
END = r"(?<=[.!?;])\s+(?=\S)"
#: Comment marks at the ends of a line.
BEFORE = r"(?m)^[ \t]*(?:/\*+[!/]?|\*+/?|//[/!]*|#+|--+|;+|%+|>+|<!--|(?:@?rem|REM|dnl)(?=[ \t]|$))?[ \t]*"
AFTER = r"(?m)[ \t]*(?:\*+/|-->|\*+)?[ \t]*$"
#: Words of a window in a long paragraph, and how far the next one is; no template has more than STRIDE words.
WINDOW = 80
STRIDE = 40
#: Words that are anchors only where a template has too few others.
COMMON = frozenset("a all and any are as at be been by for from has have in is it may no of on or that the this to under use with without work you".split())


def _template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9.+-]+|\.(?![0-9])", " ", text.lower()).split()


def _template_set(text: str) -> set[str]:
    """What template_grams() gives for a template."""
    words = _template_words(text)
    return set(words) | {" ".join(pair) for pair in zip(words, words[1:], strict=False)}


def _anchors() -> tuple[str, ...]:
    """Words of which every unit that holds CONFIRM of a template's words and bigrams has one.

    From each template words are taken, long ones first, until the grams they touch are more than a
    confirmed unit may lack: a unit without these words lacks all those grams.
    """
    found = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        grams_ = [set(g.split()) for g in _template_set(text)]
        taken = set()
        for word in sorted(set(_template_words(text)), key=lambda w: (w in COMMON, -len(w), w)):
            taken.add(word)
            if sum(not taken.isdisjoint(g) for g in grams_) > (1 - CONFIRM) * len(grams_):
                break
        found |= taken
    return tuple(sorted(found))


ANCHORS = _anchors()


def may_hold(text: Column) -> Column:
    """False only for texts of which no part can be confirmed."""
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in ANCHORS]))


def _with_words(text: Column, made) -> Column:
    """made(words of the text); the words are bound once, as a lambda over words would split the text again for each."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|\.(?!\p{N})", " "), " +"), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), made), 1)


def grams(text: Column) -> Column:
    """Distinct hashes of a paragraph's word 1- to 3-grams, lower case, punctuation as blank."""

    def runs(words: Column) -> Column:
        found = [
            F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i, n=n: F.xxhash64(F.array_join(F.slice(words, i, n), " "), F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
            for n in (1, 2, 3)
        ]
        return F.array_distinct(F.concat(*found))

    return _with_words(text, runs)


def template_grams(text: Column) -> Column:
    """What templates are compared by: distinct words and bigrams."""

    def found(words: Column) -> Column:
        pairs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(words, pairs))

    return _with_words(text, found)


def paragraphs(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """(keep..., para, sent, level, unit): the texts' paragraphs at three widths; blank units are left out.

    Level 1 are the lines of a sentence, 2 sentences joined over line ends, 3 (sent is -1) whole
    paragraphs of several sentences, or windows of WINDOW words over longer ones.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text_of(text_col), r"\r\n?", "\n"), BEFORE, ""), AFTER, "")
    blocks = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep)], F.posexplode(F.split(bare, r"\n\s*\n")).alias("para", "block"))
    names = docs.select(*keep).columns
    cut = blocks.where(F.trim("block") != "").select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)], "para", F.split("block", END).alias("sentences"), F.split(F.trim("block"), r"\s+").alias("words"))
    unit = lambda sent, level, text: F.struct(sent.alias("sent"), F.lit(level).alias("level"), text.alias("unit"))
    lines = F.flatten(F.transform("sentences", lambda s, i: F.transform(F.split(s, "\n"), lambda line: unit(i, 1, line))))
    joined = F.transform("sentences", lambda s, i: unit(i, 2, F.when(F.contains(s, F.lit("\n")), F.regexp_replace(s, r"\s+", " "))))
    starts = F.sequence(F.lit(0), (F.ceil(F.greatest(F.size("words") - WINDOW, F.lit(0)) / STRIDE) * STRIDE).cast("int"), F.lit(STRIDE))
    whole = F.when((F.size("sentences") > 1) | (F.size("words") > WINDOW), starts).otherwise(F.array().cast("array<int>"))
    wide = F.transform(whole, lambda i: unit(F.lit(-1), 3, F.array_join(F.slice("words", i + 1, F.lit(WINDOW)), " ")))
    return cut.select(*names, "para", F.explode(F.concat(lines, joined, wide)).alias("u")).select(*names, "para", "u.*").where(F.trim("unit") != "")


def known_examples(spark: SparkSession) -> DataFrame:
    """(label, source, unit), one partition: templates in variants, and prose as unknown."""
    rows = [(label, t) for label, name in enumerate(CLASSES) if name in TEMPLATES for t in TEMPLATES[name]] + [(0, p) for p in PROSE]
    known = spark.createDataFrame(rows, "label int, source string").coalesce(1)
    words = F.split("source", " ")
    dropped = F.when(F.col("v") == 0, F.col("source")).otherwise(
        F.array_join(F.filter(words, lambda w: F.pmod(F.xxhash64(w, F.col("v")), F.lit(8)) > 0), " ")
    )
    return known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).select("label", F.xxhash64("source").alias("source"), dropped.alias("unit"))


def examples(units: DataFrame) -> DataFrame:
    """(ex, label, fold, x array<bigint>): templates in variants, prose, and every different one of the units (text_key, para, unit).

    Units of paragraphs of which a template confirms a part are left out. Variants of one sentence are in one fold.
    """
    notices = units.where(confirmed(F.col("unit")) >= CONFIRM).select("text_key", "para").distinct()
    other = units.join(notices, ["text_key", "para"], "left_anti").select("unit").distinct()
    both = known_examples(units.sparkSession).unionAll(other.select(F.lit(0).alias("label"), F.xxhash64("unit").alias("source"), "unit"))
    fold = F.when(F.col("label") == 0, F.pmod(F.xxhash64("source", F.lit(5)), F.lit(5))).otherwise(1)
    made = both.select("label", "source", "unit", grams(F.col("unit")).alias("x")).where(F.size("x") > 0)
    return stage(made.select(F.xxhash64("label", "unit").alias("ex"), "label", fold.alias("fold"), "x").dropDuplicates(["ex"]), "examples")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(gram), staged: all that have a weight of their own."""
    found = known_examples(spark).select(F.explode(F.concat(grams(F.col("unit")), F.array(F.lit(BIAS).cast("bigint")))).alias("gram"))
    return stage(found.distinct().coalesce(1), "vocabulary")


def softmax(sums: DataFrame, *by: str) -> DataFrame:
    """(by..., s array<double>) -> (by..., p array<double>)."""
    powers = sums.select(*by, F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("p"))
    return powers.select(*by, F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def cells_of(x: DataFrame, vocab: DataFrame, *by: str) -> DataFrame:
    """(by..., gram, value): a unit-length row for each paragraph, and the bias as a gram of its own; of the grams those of vocab."""
    value = 1 / F.sqrt(F.size("x").cast("double"))
    grams_ = F.concat(F.transform("x", lambda g: F.struct(g.alias("gram"), value.alias("value"))), F.array(F.struct(F.lit(BIAS).cast("bigint").alias("gram"), F.lit(0.3).alias("value"))))
    cells = x.where(F.size("x") > 0).select(*by, F.explode(grams_).alias("c")).select(*by, "c.gram", "c.value")
    return cells.join(F.broadcast(vocab), "gram").select(*by, "gram", "value")


def score(cells: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """cells -> (by..., p array<double>): class probabilities; grams without weights count nothing."""
    k = len(CLASSES)
    sums = [F.sum(F.coalesce(F.get("w", F.lit(c)), F.lit(0.0)) * F.col("value")) for c in range(k)]
    return softmax(cells.join(weights, "gram", "left").groupBy(*by).agg(F.array(*sums).alias("s")), *by)


def train(found: DataFrame, vocab: DataFrame, steps: int = STEPS) -> DataFrame:
    """(gram, w array<double>) by Nesterov steps on folds 1 to 4.

    A step has one shuffle by example and one by gram; each is staged so that plans don't grow.
    """
    k = len(CLASSES)
    ours = found.where("fold > 0")
    size = ours.groupBy("label").count().collect()
    cost = {r["label"]: 1 / (len(size) * r["count"]) for r in size}  # classes weigh alike
    price = F.element_at(F.array(*[F.lit(cost.get(c, 0.0)) for c in range(k)]), F.col("label") + 1)
    cells = stage(cells_of(ours, vocab, "ex", "label"), "cells")
    zero = F.array(*[F.lit(0.0)] * k)
    state = stage(vocab.select("gram", zero.alias("w"), zero.alias("v")).coalesce(1), "weights")
    for _ in range(steps):
        ahead = state.select("gram", F.transform(F.arrays_zip("w", "v"), lambda z: z["w"] + MOMENTUM * z["v"]).alias("w"))
        errors = score(cells, F.broadcast(ahead), "ex", "label").select("ex", F.transform("p", lambda x, i: (x - (F.col("label") == i).cast("double")) * price).alias("e"))
        grads = cells.join(errors, "ex").groupBy("gram").agg(F.array(*[F.sum(F.col("value") * F.get("e", F.lit(c))) for c in range(k)]).alias("g"))
        g = F.coalesce("g", zero)
        v = F.transform(F.arrays_zip("w", "v", g.alias("g")), lambda z: MOMENTUM * z["v"] - RATE * (z["g"] + L2 * (z["w"] + MOMENTUM * z["v"])))
        moved = state.join(grads, "gram", "left").select("gram", "w", v.alias("v"))
        state = stage(moved.select("gram", F.transform(F.arrays_zip("w", "v"), lambda z: z["w"] + z["v"]).alias("w"), "v").coalesce(1), "weights")
    return state.select("gram", "w")


def calibrate(found: DataFrame, vocab: DataFrame, weights: DataFrame) -> float:
    """The least probability at which a family stands: above NULL_QUANTILE of all held-out unknown units."""
    cells = cells_of(found.where("fold = 0 and label = 0"), vocab, "ex")
    best = score(cells, F.broadcast(weights), "ex").select(F.array_max(F.slice("p", 2, len(CLASSES))).alias("m"))
    reached = best.agg(F.percentile("m", F.lit(NULL_QUANTILE)).alias("q")).first()["q"]
    return max(LEAST_PROBABILITY, reached or 0.0)


def confirmed(unit: Column, family: Column | None = None) -> Column:
    """The largest share of a template of the family, or of any, that a unit contains."""

    def share(own: Column, t: str) -> Column:
        known = sorted(_template_set(t))
        return F.size(F.array_intersect(own, F.array(*map(F.lit, known)))) / len(known)

    def best(own: Column) -> Column:
        by = {name: [share(own, t) for t in texts] for name, texts in TEMPLATES.items()}
        if family is None:
            return F.greatest(*[x for shares in by.values() for x in shares])
        out = F.lit(0.0)
        for name, shares in by.items():
            out = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(template_grams(unit)), best), 1)  # binds the unit's grams once


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, licence (the family, or null), probability, n_notices, families.

    licence is the family of the likeliest confirmed unit (the last by name on a tie), families all
    of them in order, n_notices the different confirmed units, each notice at its narrowest width; those
    seen only beyond a sentence count once for a paragraph and family. Null and empty texts and those without an anchor have no
    licence and 0 notices. Repeated rows and ids are rows of their own with equal results. An empty
    table gives no rows; other columns are ignored.
    """
    key = F.xxhash64(text_col)
    some = docs.where(may_hold(text_of(text_col)))
    units = stage(paragraphs(some, text_col, key.alias("text_key")).where(may_hold(F.col("unit"))).distinct().withColumn("unit_key", F.xxhash64("text_key", "para", "sent", "level", "unit")), "units")
    found, vocab = examples(units), vocabulary(docs.sparkSession)
    weights = train(found, vocab)
    threshold = calibrate(found, vocab, weights)
    cells = cells_of(units.select("unit_key", grams(F.col("unit")).alias("x")), vocab, "unit_key")
    p = score(cells, F.broadcast(weights), "unit_key").withColumn("top", F.array_max("p"))
    named = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("p", F.col("top")).cast("int"))
    guessed = units.join(p, "unit_key").withColumn("family", named).where((F.col("family") != "unknown") & (F.col("top") >= threshold))
    sure = guessed.where(confirmed(F.col("unit"), F.col("family")) >= CONFIRM)
    least = lambda *by: F.min("level").over(W.partitionBy("text_key", "para", "family", *by))
    narrowest = sure.withColumn("in_para", least()).withColumn("in_sent", least("sent")).where(F.when(F.col("level") == 3, F.col("in_para") == 3).otherwise(F.col("level") == F.col("in_sent")))
    notice = F.struct("family", F.when(F.col("level") < 3, F.col("unit")).alias("unit"), F.when(F.col("level") == 3, F.col("para")).alias("para"))
    by_text = narrowest.groupBy("text_key").agg(
        F.max(F.struct("top", "family")).alias("best"), F.size(F.collect_set(notice)).cast("long").alias("n_notices"), F.sort_array(F.collect_set("family")).alias("families")
    )
    by_text = stage(by_text, "notices")
    (k,) = fresh(docs, "_text_key")
    return docs.select(id_col, key.alias(k)).join(by_text.withColumnRenamed("text_key", k), k, "left").select(
        id_col, F.col("best.family").alias("licence"), F.col("best.top").alias("probability"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every text of documents."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("families", F.array_join("families", ","))
