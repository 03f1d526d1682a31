"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates; DataFrame and JVM operations only.

A paragraph is a run of lines without a blank one among them, white space and comment marks left aside; each of its lines is also a paragraph of its own, so
that a licence line inside other text is seen as well as a statement wrapped over lines. A multinomial logistic regression over hashed words and word
pairs gives each a family of licences or `unknown`. It is trained here on the families' templates, with every single word left out in turn and also
set between foreign lines, against a bounded sample of lines of the corpus (``SAMPLE`` with the lowest hashes, of lines that share a key word with a template but
no word pair) and a few sentences that speak of licences without granting one. `unknown` is calibrated over all candidate paragraphs: a family counts only
if it is likelier than for 99 in 100 of those without a word pair of any template (``LEAST`` at least). A prediction is confirmed if enough word pairs
of one of the family's templates stand in the paragraph; unconfirmed ones stay in the operator's output. A paragraph of several lines is left out where one of
its lines says the same.

Only paragraphs that some template could confirm are classified: ``key_words`` picks words of the templates so that a paragraph without any of them
lacks too many pairs of every template. This loses no confirmed licence; all other paragraphs are `unknown`. The scores are written before they are filtered:
a filter on them would otherwise be pushed below the projections and evaluate the model once for every mention.

Defined results: null and empty texts, and paragraphs without letters or digits, hold no licence; equal paragraphs get equal results; every row of
`documents` is scanned, also rows that share an id; lines count from 0; a line is blank if it has nothing but white space.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import written

FEATURES = 1 << 12
SAMPLE = 3000
LEAST = 0.5
#: Share of the candidates without any template's pair that must stay below the threshold.
HELD_BELOW = 0.99
#: Share of a template's word pairs that must stand in a paragraph.
CONFIRMED = 0.5
UNKNOWN = "unknown"

#: How licences are commonly stated, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Distributed under the terms of the Apache License 2.0.",
               "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL, version 2 or later.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under the Creative Commons Attribution License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.",
                      "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
                    "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
#: Sentences with the words of licences that grant none.
OTHER = ["The driver has to hold a valid license for this kind of vehicle.", "The version released under the new name was free of faults.",
         "Permission of the owner is needed to enter.", "The general public is invited to the reserved seats.", "Copyright law differs between countries.",
         "All rights and duties are described in the contract.", "The Apache helicopter flew over the city.", "He studied at MIT under a famous professor.",
         "The commons were open to the public.", "The license fee was raised by the commission last year."]


def key_words(share: float = CONFIRMED) -> list[str]:
    """Words of which every paragraph that holds ``share`` of a template's distinct word pairs contains one: of each template the longest words, until the
    pairs without any of them are less than that share."""
    chosen: set[str] = set()
    for said in (t for family in TEMPLATES.values() for t in family):
        parts = [w for w in re.split(r"[\W_]+", said.lower()) if w]
        joined = set(zip(parts, parts[1:], strict=False))
        for word in sorted(set(parts), key=lambda w: (len(w), w), reverse=True):
            if sum(not chosen & set(p) for p in joined) < share * len(joined):
                break
            chosen.add(word)
    return sorted(chosen)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(text: Column) -> Column:
    """(``words``, ``pairs`` of neighbouring words, ``both``) of a text, split once."""
    def of(w: Column) -> Column:
        joined = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda second, i: F.concat(F.get(w, i), F.lit(" "), second))
        return let(joined, lambda p: F.struct(w.alias("words"), p.alias("pairs"), F.concat(w, p).alias("both")))

    return let(words(text), of)


def let(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def may_be_confirmed(said: Column) -> Column:
    """Whether a text in lower case has one of the key words; short ones count as whole words only, as they stand inside many others."""
    found, short = F.lit(False), [w for w in key_words() if len(w) < 4]
    for word in key_words():
        if word not in short:
            found = found | said.contains(word)
    if not short:
        return found
    some = F.lit(False)
    for word in short:
        some = some | said.contains(word)
    whole = "|".join(rf"{w}(?<![\p{{L}}\p{{N}}]{w})" for w in short)
    return found | (some & said.rlike(rf"(?:{whole})(?![\p{{L}}\p{{N}}])"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, block, line, last_line, said`` of every paragraph of one line or more that a template may confirm; ``block`` tells the paragraphs of rows apart
    that share an id. Lines carry their numbers while the text is cut at blank lines, so nothing is counted twice."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).where(may_be_confirmed(F.col("low")))
    numbered = F.array_join(F.transform(F.split("low", "\n"), lambda line, i: F.concat(i, F.lit("\t"), line)), "\n")
    blocks = low.select("doc_id", F.explode(F.split(numbered, r"\n(?=\d+\t\s*(?:\n\d+\t|$))")).alias("block")).where(may_be_confirmed(F.col("block")))
    told = F.filter(F.transform(F.split("block", "\n"), lambda x: F.struct(
        F.substring_index(x, "\t", 1).cast("int").alias("line"), F.regexp_replace(x, r"^\d+\t", "").alias("said"))), lambda x: x["said"].rlike(r"\S"))

    def paragraphs(lines: Column) -> Column:
        one = F.transform(F.filter(lines, lambda x: may_be_confirmed(x["said"])), lambda x: F.struct(x["line"].alias("line"), x["line"].alias("last_line"), x["said"].alias("said")))
        whole = F.struct(F.get(lines, F.lit(0))["line"].alias("line"), F.element_at(lines, -1)["line"].alias("last_line"),
                         F.array_join(F.transform(lines, lambda x: x["said"]), " ").alias("said"))
        return F.when(F.size(lines) > 1, F.concat(F.array(whole), one)).otherwise(one)

    each = blocks.select("doc_id", F.xxhash64("block").alias("block"), F.explode(let(told, paragraphs)).alias("p"))
    return each.select("doc_id", "block", "p.line", "p.last_line", "p.said")


def templates(spark: SparkSession) -> DataFrame:
    rows = ", ".join("('{}', '{}')".format(f, t.replace("'", "''")) for f, ts in TEMPLATES.items() for t in ts)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, said)").withColumn("grams", grams(F.col("said")))


def template_pairs() -> list[str]:
    """The word pairs of all templates: a fixed number."""
    out = set()
    for said in (t for family in TEMPLATES.values() for t in family):
        parts = [w for w in re.split(r"[\W_]+", said.lower()) if w]
        out |= {f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)}
    return sorted(out)


def features(df: DataFrame) -> DataFrame:
    """``features``: words and pairs in hashed places, scaled to length one. They are hashed inside the JVM."""
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="both", outputCol="__counts").transform(df)
    return Normalizer(p=2.0, inputCol="__counts", outputCol="features").transform(counted).drop("__counts")


def training_lines(found: DataFrame, sample: int) -> DataFrame:
    """``label`` (number of the family in the order of TEMPLATES; 0: unknown) and ``both``."""
    spark = found.sparkSession
    known = templates(spark)
    numbers = F.create_map(*[x for i, f in enumerate(TEMPLATES) for x in (F.lit(f), F.lit(float(i + 1)))])
    size = F.size("grams.words")
    less = known.withColumn("out", F.explode(F.sequence(F.lit(-1), size - 1))).where((F.col("out") < 0) | (size > 3))
    stated = less.select(numbers[F.col("family")].alias("label"), F.array_join(F.filter("grams.words", lambda w, i: i != F.col("out")), " ").alias("said"))
    single = found.where("line = last_line").select("said", F.xxhash64("said").alias("h"))
    # about twice the sample goes on by hash, so that the task that sorts gets a number of lines that doesn't grow
    share = max(1, single.agg(F.approx_count_distinct("h")).first()[0] // (2 * sample))
    lines = single.where(F.pmod("h", F.lit(share)) == 0).distinct().orderBy("h", "said").limit(sample)
    pairs = F.array(*map(F.lit, template_pairs()))
    strange = written(lines.where(~F.arrays_overlap(grams(F.col("said"))["pairs"], pairs)), "licence-lines")
    count = sum(map(len, TEMPLATES.values()))
    texts = [(i, t) for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    of = [float(k + 1) for k, ts in enumerate(TEMPLATES.values()) for _ in ts]
    each = spark.createDataFrame([(i, t, of[i]) for i, t in texts], "number int, template string, label double")
    between = strange.withColumn("number", F.pmod("h", F.lit(count)).cast("int")).join(F.broadcast(each), "number").select(
        "label", F.concat_ws(" ", "said", "template", "said").alias("said"))
    quoted = spark.createDataFrame([(0.0, t) for t in OTHER], "label double, said string")
    every = stated.union(between).union(strange.select(F.lit(0.0), "said")).union(quoted)
    return every.select("label", grams(F.col("said"))["both"].alias("both")).where(F.size("both") > 0)


def trained(found: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel:
    """The classifier; families together weigh as much as the unknown lines."""
    rows = features(written(training_lines(found, sample).coalesce(1), "licence-lines"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weights = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(sum(counts.values()) / len(counts) / n))])
    return LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, weightCol="weight", predictionCol="").fit(rows.withColumn("weight", weights[F.col("label")]))


def licences(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, line, last_line, family, probability, similarity, confirmed`` of every paragraph that the classifier takes for a licence, of those that a template
    may confirm; ``similarity`` is the share of the closest template's word pairs in the paragraph."""
    found = written(candidates(docs), "licence-paragraphs")
    known = templates(docs.sparkSession).groupBy("family").agg(F.collect_list("grams.pairs").alias("known"))
    names = F.array(F.lit(UNKNOWN), *map(F.lit, TEMPLATES))
    split = found.select("doc_id", "block", "line", "last_line", grams(F.col("said")).alias("g")).select(
        "doc_id", "block", "line", "last_line", F.col("g.pairs").alias("pairs"), F.col("g.both").alias("both"))
    chances = trained(found, sample).transform(features(split)).select("doc_id", "block", "line", "last_line", "pairs", vector_to_array("probability").alias("p"))
    best = chances.select("doc_id", "block", "line", "last_line", "pairs", let(F.col("p"), lambda p: F.struct(
        F.array_max(p).alias("probability"), F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("family"))).alias("best"))
    shares = F.transform("known", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.size(F.array_distinct(t)))
    near = best.join(F.broadcast(known), F.col("best.family") == known["family"], "left")  # a row for each family
    scored = written(near.select("doc_id", "block", "line", "last_line", F.col("best.family").alias("family"), F.col("best.probability").alias("probability"),
                                 F.coalesce(F.array_max(shares), F.lit(0.0)).alias("similarity"),
                                 F.arrays_overlap("pairs", F.array(*map(F.lit, template_pairs()))).alias("akin")), "licence-scores")
    strange = scored.where(~F.col("akin")).select(F.when(F.col("family") == UNKNOWN, 1 - F.col("probability")).otherwise(F.col("probability")).alias("p"))
    least = max(LEAST, strange.agg(F.percentile_approx("p", F.lit(HELD_BELOW), F.lit(10_000))).first()[0] or 0.0)
    said = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least)).withColumn("confirmed", F.col("similarity") >= CONFIRMED)
    level = F.col("confirmed").cast("int") + 1
    by_line = F.max(F.when(F.col("line") == F.col("last_line"), level).otherwise(0)).over(Window.partitionBy("doc_id", "block", "family"))
    kept = said.withColumn("by_line", by_line).where((F.col("line") == F.col("last_line")) | (level > F.col("by_line")))
    return kept.select("doc_id", "line", "last_line", "family", "probability", "similarity", "confirmed")


@query("op9_licence_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Licences stated in any paragraph of any document; what no template confirms counts as unknown."""
    return licences(table(spark, folder, "documents")).where("confirmed")
