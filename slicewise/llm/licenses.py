"""Licence scans by a trained paragraph classifier, in DataFrame and Spark ML operations only.

Paragraphs are lines up to a blank one. Their lines (long ones in overlapping windows) and
every passage of theirs that holds most word pairs of a notice, wherever lines break, are
classified by multinomial logistic regression over hashed word 1- and 2-grams: those of the notices, and how many
other words there are. Training paragraphs are public licence notices with words left out, by hash; the unknown class
learns from all lines of the corpus, and from shuffled notices, whose words are right and whose order is not. Lines with the
same features are one training row with their number, so no line is left out and the fit meets distinct rows only.
A family is predicted when its probability reaches a threshold that is calibrated on
all held-out lines, one in four by hash; the prediction is confirmed when the line or passage
holds most word pairs of one of the family's notices.

Defined results: a null text has no paragraphs; paragraphs without a word do not count;
every row of the table gives one row, repeated rows equal ones; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.session import durable

UNKNOWN = "unknown"
#: Public licence notices by family.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC0", "SPDX-License-Identifier: CC0-1.0"),
)
FAMILIES = sorted({f for f, _ in NOTICES})
FEATURES = 1 << 14
#: Variants of each notice, which weigh 1; weight of all corpus lines of the fit together; expected number of lines of a sample.
VARIANTS, CORPUS_WEIGHT, CORPUS_SAMPLE = 30, 2250, 3000
#: Share of unknown held-out paragraphs that may reach the threshold; share of a notice's word pairs that confirms it.
FALSE_ALARM, CONFIRMED = 0.002, 0.6
#: Thresholds are steps of the log odds, so many a unit, from 0 to the last one.
STEPS, LAST_STEP = 64, 64 * 36
#: Words of a window of a long line; next windows start half of it later.
WINDOW = 64
#: Where a paragraph ends.
BLANK_LINE = r"\n[^\S\n]*\n"
#: A word broken at its hyphen; a comment mark may begin the next line.
BROKEN = r"(?<=\p{L})-[^\S\n]*\n[^\p{L}\p{N}\n]*"


def words(text: Column) -> Column:
    """Hashes of the lower-cased words of letters, digits and inner points or hyphens; empty array without any.

    Everything after this goes by hashes: windows, word pairs and features compare numbers.
    """
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}.-]+|[.-]+(?![\p{L}\p{N}])", " "))
    # a split at one plain blank needs no expression compiled for every line
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def pairs(tokens: Column) -> Column:
    """Hashes of neighbouring words."""
    first = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(first, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds ``grams`` to rows with the hashes ``words`` and ``pairs``: the notices' words and pairs among them, and how many
    other words there are, doubling from code to code. Equal sets are equal arrays."""
    _, all_words, all_pairs = templates(rows.sparkSession)
    rows = rows.withColumn("known", F.array_intersect(all_words, "words"))
    others = F.size(F.array_distinct("words")) - F.size("known")
    # a code below any hash that occurs; none without other words
    code = F.when(others > 0, F.array(F.ceil(F.log2(others + 1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("grams", F.concat("known", F.array_intersect(all_pairs, "pairs"), code)).drop("known")


def hashed(rows: DataFrame) -> DataFrame:
    """Adds binary ``features`` to rows with ``grams``."""
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(rows)


def featured(rows: DataFrame) -> DataFrame:
    """Adds ``grams`` and their binary ``features`` to rows with the hashes ``words`` and ``pairs``."""
    return hashed(with_grams(rows))


def windows(tokens: Column, length: Column, step: Column) -> Column:
    """All windows of ``length`` words, ``step`` words apart; the last one reaches the end."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - length + step, F.lit(1)), step)
    return F.transform(starts, lambda at: F.slice(tokens, at, length))


def passages(template: Column, tokens: Column, known: Column) -> Column:
    """The parts of a paragraph that hold a notice: windows half as long again as it, from its first word pair to its last.

    Where another notice has more word pairs in the window, the words are that one's.
    """
    n = F.size(template["words"])
    spare = F.greatest(F.floor(n / 2).cast("int"), F.lit(4))

    def cut(window: Column) -> Column:
        hits = F.transform(pairs(window), lambda p: F.array_contains(template["pairs"], p))
        first, after = F.array_position(hits, True).cast("int"), F.array_position(F.reverse(hits), True).cast("int")
        return F.slice(window, F.greatest(first, F.lit(1)), F.size(hits) - first - after + 3)

    size = lambda t, w: F.size(F.array_intersect(t["pairs"], pairs(w)))
    held = F.filter(windows(tokens, n + spare, spare), lambda w: holds(template, pairs(w)))
    return F.transform(F.filter(held, lambda w: ~F.exists(known, lambda t: size(t, w) > size(template, w))), cut)


def segments(docs: DataFrame, known: Column, all_pairs: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, block, words, pairs) of the lines and notice passages of every paragraph."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    block = numbered.select("row", "doc_id", F.posexplode(F.split("text", BLANK_LINE)).alias("block", "body"))
    lines = F.transform(F.split(F.regexp_replace("body", BROKEN, "-"), "\n"), words)
    block = block.select("row", "doc_id", "block", lines.alias("lines"))
    block = block.withColumn("tokens", F.flatten("lines"))
    # the few notice pairs a paragraph has: what it does not hold as a whole, no window holds
    told = block.withColumn("found", F.array_intersect(all_pairs, pairs(F.col("tokens"))))
    held = F.filter(known, lambda t: holds(t, F.col("found")))
    noticed = F.when(F.size("found") > 0, F.flatten(F.transform(held, lambda t: passages(t, F.col("tokens"), held))))
    cut = lambda w: windows(w, F.lit(WINDOW), F.lit(WINDOW // 2))
    short = F.flatten(F.transform("lines", lambda w: F.when(F.size(w) <= WINDOW, F.array(w)).otherwise(cut(w))))
    nothing = F.array().cast("array<array<bigint>>")
    # the outer form: the plain one infers a filter that works all of this out once more
    return (told.select("row", "doc_id", "block", F.explode_outer(F.concat(short, F.coalesce(noticed, nothing))).alias("words"))
            .withColumn("pairs", pairs(F.col("words"))))


def notices(spark: SparkSession) -> DataFrame:
    """(label, family, nth, words): the notices with their labels, from 1; 0 is unknown."""
    rows = [(FAMILIES.index(f) + 1, f, i, t) for i, (f, t) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "label int, family string, nth int, text string").withColumn("words", words(F.col("text")))


def templates(spark: SparkSession) -> tuple[Column, Column, Column]:
    """The notices' labels, words and word pairs as one array, all their words and all their word pairs: a few dozen fixed texts, no join."""
    known = notices(spark).withColumn("pairs", pairs(F.col("words"))).orderBy("nth").collect()
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    each = F.array(*[F.struct(F.lit(r.label).alias("label"), longs(r.words).alias("words"), longs(sorted(set(r.pairs))).alias("pairs")) for r in known if r.pairs])
    return each, longs(sorted({w for r in known for w in r.words})), longs(sorted({p for r in known for p in r.pairs}))


def holds(template: Column, found: Column) -> Column:
    """Whether a paragraph's word pairs hold enough of a notice's."""
    return F.size(F.array_intersect(template["pairs"], found)) >= CONFIRMED * F.size(template["pairs"])


def sampled_lines(docs: DataFrame, text: str) -> DataFrame:
    """(words, pairs) of about CORPUS_SAMPLE different lines, from anywhere in any document.

    For a quick fit; the query learns from all lines. A hash of the line draws it, so a line that stands everywhere is drawn once or not at
    all; of a line longer than a window one window is taken, at a place by hash.
    """
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    total = docs.agg(F.sum(F.size(F.split(F.col(text), "\n")))).first()[0] or 1
    share = min(1.0, CORPUS_SAMPLE / max(total, 1))
    drawn = lines.filter(F.pmod(F.xxhash64("line", F.lit("licence sample")), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    told = drawn.select("line", words(F.col("line")).alias("w"))
    at = 1 + F.pmod(F.xxhash64("line"), F.greatest(F.size("w") - WINDOW, F.lit(0)) + 1)
    return (told.select(F.slice("w", at.cast("int"), F.lit(WINDOW)).alias("words")).distinct()
            .withColumn("pairs", pairs(F.col("words"))))


def notice_rows(spark: SparkSession) -> DataFrame:
    """(label, held_out, grams, n): notices in variants and shuffled notices, each one row."""
    known = notices(spark)
    copies = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    chance = lambda w, i, salt: F.pmod(F.xxhash64(w, i, F.col("v"), F.col("nth"), F.lit(salt)), F.lit(1000)) / 1000.0
    fewer = F.filter("words", lambda w, i: (F.col("v") == 0) | (chance(w, i, "drop") > 0.008 * F.col("v")))
    shuffled = F.transform(F.array_sort(F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i, F.col("v"), F.lit("order")).alias("k"), w.alias("w")))), lambda s: s["w"])
    held = F.pmod(F.xxhash64("v", "nth"), F.lit(4)) == 0
    variants = copies.select("label", held.alias("held_out"), fewer.alias("words"))
    wrong = copies.filter("v < 8 and size(words) > 6").select(F.lit(0).alias("label"), F.lit(False).alias("held_out"), shuffled.alias("words"))
    rows = with_grams(variants.unionAll(wrong).withColumn("pairs", pairs(F.col("words"))))
    return rows.select("label", "held_out", "grams", F.lit(1).cast("bigint").alias("n"))


def coded(rows: DataFrame) -> DataFrame:
    """Rows with the hashes ``words`` and ``pairs`` as what the fit and the scan need of them: any, held_out, grams.

    Written once for both.
    """
    held = F.pmod(F.xxhash64("words", F.lit("held out")), F.lit(4)) == 0
    place = [c for c in ("row", "doc_id", "block") if c in rows.columns]
    return durable(with_grams(rows).select(*place, (F.size("words") > 0).alias("any"), held.alias("held_out"), "grams"), "licence-segments")


def coded_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All lines and notice passages of ``docs``, coded."""
    known, _, all_pairs = templates(docs.sparkSession)
    return coded(segments(docs, known, all_pairs, doc_id, text))


def corpus_rows(lines: DataFrame) -> DataFrame:
    """(label, held_out, grams, n) of coded lines: n of them have the same grams; those that hold a notice would be wrong labels."""
    known = templates(lines.sparkSession)[0]
    alike = lines.filter("any").groupBy("held_out", "grams").agg(F.count(F.lit(1)).alias("n"))
    return alike.filter(~F.exists(known, lambda t: holds(t, F.col("grams")))).select(F.lit(0).alias("label"), "held_out", "grams", "n")


def fit(lines: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the threshold of its family probabilities, from all coded lines."""
    told = durable(notice_rows(lines.sparkSession).coalesce(1), "licence-notices")
    corpus = durable(corpus_rows(lines), "licence-lines")
    learned = corpus.filter("not held_out").agg(F.sum("n")).first()[0] or 1
    rows = (told.withColumn("weight", F.lit(1.0)).unionAll(corpus.withColumn("weight", F.col("n") * (CORPUS_WEIGHT / learned)))
            .filter("not held_out"))
    regression = LogisticRegression(maxIter=25, regParam=0.002, family="multinomial", standardization=False, weightCol="weight",
                                    probabilityCol="probability", rawPredictionCol="", predictionCol="")
    model = regression.fit(hashed(rows).select("label", "weight", "features"))
    return model, calibrated(model, corpus.filter("held_out"))


def calibrated(model: LogisticRegressionModel, unknown: DataFrame) -> float:
    """The lowest step of the log odds that at most FALSE_ALARM of the unknown lines (grams, n) reach, as a probability from 0.5 on."""
    none = vector_to_array("probability")[0]
    scored = model.transform(hashed(unknown).select("features", "n")).select("n", none.alias("none"))
    odds = F.log1p(-F.col("none")) - F.log(F.greatest("none", F.lit(1e-300)))
    step = F.greatest(F.lit(0), F.least(F.lit(LAST_STEP), F.floor(odds * STEPS).cast("int")))
    counts = {r.step: r.n for r in scored.groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect()}  # LAST_STEP + 1 rows at most
    spare = FALSE_ALARM * sum(counts.values())
    lowest = 0
    for at in sorted(counts, reverse=True):
        spare -= counts[at]
        if spare < 0:
            lowest = at + 1 if at else 0
            break
    return 1 / (1 + math.exp(-lowest / STEPS))


def train(spark: SparkSession, docs: DataFrame, text: str = "text", sample: bool = False) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the threshold from the lines of ``docs``: all of them, or a bounded sample."""
    lines = coded(sampled_lines(docs, text)) if sample else coded_segments(docs.select(F.lit(0).alias("doc_id"), text), text=text)
    return fit(lines)


def scan(docs: DataFrame, model: LogisticRegressionModel, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_paragraphs, n_predicted, n_confirmed, families, license, probability.

    ``families`` are the confirmed ones in order, joined by commas; ``license`` is that
    of the likeliest confirmed line or passage, or ``none``.
    """
    return judged(coded_segments(docs, doc_id, text), model, threshold)


def judged(lines: DataFrame, model: LogisticRegressionModel, threshold: float) -> DataFrame:
    """The rows of :func:`scan` from coded segments."""
    known = templates(lines.sparkSession)[0]
    scored = model.transform(hashed(lines)).withColumn("chance", vector_to_array("probability"))
    chance = F.col("chance")  # a column of its own, so that it is worked out once
    best = F.when(1 - chance[0] < threshold, F.lit(0)).otherwise(
        F.array_position(F.slice(chance, 2, len(FAMILIES)), F.array_max(F.slice(chance, 2, len(FAMILIES)))).cast("int"))
    told = scored.select("row", "doc_id", "block", "any", "grams", best.alias("label"), (1 - chance[0]).alias("p"))
    held = F.exists(F.filter(known, lambda t: t["label"] == F.col("label")), lambda t: holds(t, F.col("grams")))
    checked = told.withColumn("confirmed", F.when(F.col("any") & (F.col("label") > 0), held).otherwise(F.lit(False)))
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.greatest("label", F.lit(1)))
    family = F.when(F.col("confirmed"), name)
    whole = checked.groupBy("row", "doc_id", "block").agg(
        F.max("any").alias("any"), F.max(F.col("any") & (F.col("label") > 0)).alias("predicted"), F.max("confirmed").alias("confirmed"),
        F.collect_set(family).alias("names"), F.max(F.when(F.col("confirmed"), F.struct("p", name.alias("f")))).alias("top"))
    count = lambda c: F.count(F.when(F.col(c), 1)).cast("bigint")
    named = F.array_distinct(F.flatten(F.collect_set("names")))
    return (whole.groupBy("row", "doc_id").agg(
        count("any").alias("n_paragraphs"), count("predicted").alias("n_predicted"), count("confirmed").alias("n_confirmed"),
        F.array_join(F.array_sort(named), ",").alias("families"),
        F.coalesce(F.max("top")["f"], F.lit("none")).alias("license"), F.max("top")["p"].alias("probability")).drop("row"))
