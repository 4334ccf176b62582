"""Licence families of paragraphs: a sparse word n-gram classifier, confirmed by templates.

Training rows are the notices of :data:`TEMPLATES`, each in ``VARIANTS`` versions with words left out and text of the
corpus before and after it, and two kinds of unknown paragraphs: :data:`OTHER` (sentences
that speak of licences without being one) and a bounded draw of corpus paragraphs (``DRAWN``
at most) that share no three-word run with a template.  A multinomial logistic regression
with an elastic penalty over the presence of one- and two-word terms keeps few weights.  Its
temperature is chosen by the log loss of versions that it was not fitted on, so that "unknown"
is a calibrated class; a paragraph gets a family if that family is the likeliest class and
reaches ``LEAST``.  A prediction is confirmed if the paragraph holds at least ``CONFIRM`` of
the three-word runs of one of the family's templates.

Scoring reads the texts once: the paragraphs' term and run hashes are joined with one table of
weights and template runs (bounded by the terms of the training rows and the templates; broadcast
after a count) and summed per paragraph, combined on the map side.  Paragraphs are lines; around the end of every line a window of the
words before and after it, ``SPAN`` on each side, finds the notices that are wrapped over several lines.  Two bounds that lose nothing
come first: a window is made only in texts that hold a run of a template, and a paragraph is scored only if the lifts of its words
(:class:`Model`) could make a family as likely as "unknown".  Main path and training use DataFrame expressions and
Spark's own estimator only.

Rows: null and wordless texts have no paragraphs; null ids are kept; repeated rows repeat
their findings; very long lines are paragraphs like others.  Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import text_of
from netloom.llm.decontaminate import words_of
from netloom.operators.stages import settle

UNKNOWN = "unknown"
VARIANTS = 24
DRAWN = 3000
LEAST = 0.5
CONFIRM = 0.6
RUN = 3
BROADCAST = 200_000

# Usual short notices of each licence family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is distributed under the Apache License 2.0.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Distributed under the GNU GPL v3 or later.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is available under the MIT license.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved. No part may be reproduced without permission.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
}
# Sentences that are no notice.
OTHER = (
    "He lost his driving licence after the accident last year.",
    "The restaurant is licensed to sell wine and beer.",
    "A licence plate was found near the public road.",
    "The general spoke to the public about version two of the plan.",
    "All seats are reserved for members with a right to vote.",
    "Permission to enter the building is granted by the office.",
    "The Apache helicopter landed under the bridge.",
    "Students of MIT released a new record.",
    "This work is hard and the source is free.",
    "A copy of the software was sold without charge.",
    "The rights of the person are all in the law.",
    "The commons are open to the creative public of the town.",
)
# Notices of licences that are none of the families but share their words.
RELATIVES = (
    "Licensed under the GNU Lesser General Public License, version 3.",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "Distributed under the GNU LGPL v3 or later.",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
    "Distributed under the GNU GPL v2 or later.",
    "Licensed under the GNU General Public License version 2 only.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    "Distributed under the GNU AGPL v3 or later.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivs 4.0 International License.",
    "Licensed under the Mozilla Public License 1.1.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "Licensed under the Apache License, Version 1.1.",
    "This project is distributed under the Apache License 1.1.",
    "Licensed under the BSD 2-Clause License.",
    "Licensed under the BSD 4-Clause License.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Licensed under the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence 1.2.",
    "Released under the Boost Software License 1.0.",
    "This project is available under the zlib license.",
)
# Further wordings of the families, to learn from beside their relatives; they are no templates.
WORDINGS = {
    "gpl-3.0": (
        "This code is licensed under the GNU General Public License, version 3.",
        "The software is licensed under the GNU General Public License version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This file is part of a program under the GNU General Public License, version 3 or later.",
        "Licensed under the GNU General Public License version 3 only.",
        "Licensed under the GNU GPL v3.",
    ),
    "cc-by": ("The data are licensed under a Creative Commons Attribution 4.0 International License.", "Published under CC BY 4.0."),
    "cc-by-nc": (
        "The data are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Published under CC BY-NC 4.0.",
    ),
    "mpl-2.0": ("The library is licensed under the Mozilla Public License 2.0.", "Subject to the Mozilla Public License, version 2.0."),
    "bsd": ("The library is licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "apache-2.0": ("The library is licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."),
    "mit": ("The library is released under the MIT License.", "Licensed under the MIT License."),
}


def _families() -> list[str]:
    return [*TEMPLATES, UNKNOWN]


def term_hashes(words: Column) -> Column:
    """Hashes of the one- and two-word terms, each once."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    one = F.transform(words, lambda w: F.xxhash64(w))
    two = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.lit(2)))
    return F.array_distinct(F.concat(one, two))


def _runs(words: Column, width: int = RUN) -> Column:
    n = F.greatest(F.lit(1), F.size(words) - width + 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(words, k, width), " ")))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


# A template that starts in a line and goes on in later ones has at most so many words on either side of the line's end.
SPAN = max(len(t.replace("/", " ").replace("-", " ").replace(".", " ").split()) for ts in TEMPLATES.values() for t in ts) - 1


def _windows(rows: DataFrame, runs: list[int] | None, *key: str) -> DataFrame:
    """``key.., place, nth, wrapped, words``: the lines with words (``nth`` counts these), and for each one that others follow the window around its end.

    With ``runs`` (hashes), windows are made only in texts that hold one of them.
    """
    lines = F.transform(F.split(text_of(F.col("text")), r"[\n\r]+"), lambda t, i: F.struct(i.alias("place"), words_of(t).alias("own")))
    rows = rows.select(*key, F.filter(lines, lambda x: F.size(x["own"]) > 0).alias("lines"))
    rows = rows.withColumn("all", F.flatten(F.col("lines.own"))).withColumn("held", _holds(F.col("all"), runs)).drop("all")
    rows = rows.withColumn("heads", F.when(F.col("held"), F.transform("lines", lambda x: F.slice(x["own"], 1, SPAN))))
    after = f"IF(held, slice(flatten(slice(heads, i + 2, {SPAN})), 1, {SPAN}), array())"
    rows = rows.select(*key, F.posexplode(F.expr(f"transform(lines, (x, i) -> struct(x.place AS place, x.own AS own, {after} AS after))")).alias("nth", "l"))
    end = f"concat(slice(l.own, greatest(1, size(l.own) - {SPAN - 1}), {SPAN}), l.after)"
    both = F.expr(f"filter(array(struct(false AS wrapped, l.own AS words), struct(true AS wrapped, {end} AS words)), x -> NOT x.wrapped OR size(l.after) > 0)")
    return rows.select(*key, "l.place", "nth", F.explode(both).alias("x")).select(*key, "place", "nth", "x.wrapped", "x.words")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``tid, place, line`` of every line with words, counted from 0; ``tid`` is the 128-bit hash of the text."""
    rows = docs.select(_key(F.col("text")).alias("tid"), F.posexplode(F.split(text_of(F.col("text")), r"[\n\r]+")).alias("place", "line"))
    return rows.where(F.lower("line").rlike(r"[\p{L}\p{N}]"))


def template_runs(spark: SparkSession) -> DataFrame:
    """``family, template, run, n_runs``."""
    rows = [(f, k, t) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", words_of(F.col("text")))
    df = df.select("family", "template", _runs(F.col("words")).alias("runs"))
    return df.select("family", "template", F.size("runs").alias("n_runs"), F.explode("runs").alias("run"))


def training_rows(docs: DataFrame, drawn: int = DRAWN, variants: int = VARIANTS) -> DataFrame:
    """``family, words, fold``; every third version of a notice is in fold 0."""
    spark = docs.sparkSession
    known = template_runs(spark).select("run").distinct().withColumnRenamed("run", "known")
    # The smallest hashes of the paragraphs: the same draw for any partitioning.
    lines = paragraphs(docs).withColumn("draw", F.xxhash64("tid", "place"))
    # Copies of a text are one before the limit; only keys are shuffled for it.
    keys = settle(lines.select("draw", "tid", "place").distinct().orderBy("draw", "tid", "place").limit(drawn), "license-draw")
    least = lines.join(F.broadcast(keys), ["draw", "tid", "place"], "left_semi").dropDuplicates(["draw", "tid", "place"])
    least = settle(least.select("tid", "place", words_of(F.col("line")).alias("words"), "draw"), "license-lines")
    alike = least.select("draw", F.explode(_runs(F.col("words"))).alias("run")).join(F.broadcast(known), F.col("run") == F.col("known"))
    plain = least.join(alike.select("draw").distinct(), "draw", "left_anti")
    fillers = [r.words[:8] for r in plain.orderBy("draw").limit(50).select("words").collect()] or [["a"]]
    fixed = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(f, t) for f, ts in WORDINGS.items() for t in ts] + [(UNKNOWN, t) for t in OTHER + RELATIVES]
    notices = spark.createDataFrame(fixed, "family string, text string").withColumn("w", words_of(F.col("text")))
    notices = notices.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    # Version 0 and 1 are whole; later ones lack about one word in eight.
    kept = F.expr("filter(w, (x, i) -> v < 2 OR pmod(xxhash64(text, v, i), 8) > 0)")
    pool = spark.createDataFrame([(k, f) for k, f in enumerate(fillers)], "k int, filler array<string>")
    notices = notices.withColumn("at", F.pmod(F.xxhash64("text", "v"), F.lit(len(fillers))).cast("int"))
    notices = notices.join(F.broadcast(pool), F.col("at") == F.col("k"))
    words = F.when(F.col("v") % 2 == 0, kept).when(F.col("v") % 4 == 1, F.concat("filler", kept)).otherwise(F.concat(kept, "filler"))
    made = notices.select("family", words.alias("words"), (F.col("v") % 3).alias("fold"))
    unknown = plain.select(F.lit(UNKNOWN).alias("family"), "words", F.pmod("draw", F.lit(3)).cast("int").alias("fold"))
    return made.unionByName(unknown)


@dataclass
class Model:
    """Weights per term hash, template runs in the same table, biases and the temperature.

    A word's lift is the most that it and the pairs it begins can raise a family's margin over that of "unknown"; a
    paragraph whose words' lifts stay below the least gap between the biases has no family.
    """

    weights: DataFrame  # term long, w0.. double per family, t0.. int per template
    biases: list[float]
    temperature: float
    sizes: list[tuple[str, int]]  # family and number of runs of each template
    lifts: dict[str, float] | None = None  # of the words with a positive one; None: not known
    runs: list[int] | None = None  # hashes of the templates' runs; None: not known


def run_hashes(words: Column, width: int = RUN) -> Column:
    """Hashes of the three-word runs, each once."""
    n = F.size(words) - width + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)), F.lit(width))))


def _holds(words: Column, runs: list[int] | None) -> Column:
    """Whether a three-word run is one of ``runs``."""
    if runs is None:
        return F.lit(True)
    n = F.size(words) - RUN + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(RUN)), F.lit(RUN)).isin(runs))


def _lifts(rows: DataFrame, weights: dict[int, list[float]]) -> dict[str, float]:
    """The positive lifts of the words in ``rows``, which hold all terms of ``weights`` (the last class is "unknown")."""
    gains = [(t, max(w[:-1]) - w[-1]) for t, w in weights.items()]
    gains = rows.sparkSession.createDataFrame([g for g in gains if g[1] > 0], "term long, gain double")
    w = F.col("words")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    kinds = (lambda i: (F.lit(None), F.xxhash64(F.get(w, i))), lambda i: (F.get(w, i + 1), F.xxhash64(F.get(w, i), F.get(w, i + 1), F.lit(2))))
    part = lambda kind: F.transform(starts, lambda i: F.struct(F.get(w, i).alias("word"), kind(i)[0].cast("string").alias("after"), kind(i)[1].alias("term")))
    terms = rows.select(F.explode(F.concat(*map(part, kinds))).alias("x")).select("x.*").distinct().join(F.broadcast(gains), "term").collect()
    usual = rows.where(F.col("label") == len(TEMPLATES)).select(F.explode("words").alias("word")).groupBy("word").count()
    usual = {r["word"]: r["count"] for r in usual.collect()}
    # A pair counts with its less usual word.  A place in a text has one term of each kind: the word, with the next and with the one before.
    most: dict[tuple[str, str], float] = {}
    for r in terms:
        second = r.after is not None and usual.get(r.after, 0) < usual.get(r.word, 0)
        kind = (r.after, "before") if second else (r.word, "next" if r.after is not None else "own")
        most[kind] = max(most.get(kind, 0.0), r.gain) if kind[1] != "own" else most.get(kind, 0.0) + r.gain
    lifts: dict[str, float] = {}
    for (word, _), gain in most.items():
        lifts[word] = lifts.get(word, 0.0) + gain
    return lifts


def _may_have_family(words: Column, model: Model) -> Column:
    """Whether the words' lifts reach the least gap between the biases: true for every paragraph that a family is likeliest for."""
    gap = model.biases[-1] - max(model.biases[:-1])
    if model.lifts is None or gap <= 0:
        return F.lit(True)
    if not model.lifts:
        return F.lit(False)
    # A few levels, rounded up; the words of one level are one hash set.
    levels: dict[float, list[str]] = {}
    for word, lift in model.lifts.items():
        levels.setdefault(math.ceil(lift * 2) / 2, []).append(word)
    level = lambda x: F.coalesce(*(F.when(x.isin(found), F.lit(at)) for at, found in sorted(levels.items())), F.lit(0.0))
    lifting = F.filter(words, lambda x: x.isin(list(model.lifts)))
    return F.aggregate(lifting, F.lit(0.0), lambda a, x: a + level(x)) >= gap - 1e-6


def _template_hashes(spark: SparkSession) -> list[tuple[str, list[int]]]:
    fixed = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    df = spark.createDataFrame(fixed, "family string, text string").withColumn("words", words_of(F.col("text")))
    return [(r.family, r.runs) for r in df.select("family", run_hashes(F.col("words")).alias("runs")).collect()]


def _margins(biases: list[float], temperature: float) -> Column:
    """From the summed weights ``s0..``."""
    return F.array(*((F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + b) / temperature for k, b in enumerate(biases)))


def _share(margins: Column, margin: Column) -> Column:
    """The probability of the class with ``margin``."""
    return 1.0 / F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(m - margin))


def _summed(terms: DataFrame, weights: DataFrame, n: int, *key: str) -> DataFrame:
    rows = terms.join(weights, F.col("hash") == F.col("term"))
    return rows.groupBy(*key).agg(*(F.sum(f"w{k}").alias(f"s{k}") for k in range(n)))


def train(docs: DataFrame) -> Model:
    spark, families = docs.sparkSession, _families()
    rows = training_rows(docs).withColumn("hashes", term_hashes(F.col("words")))
    number = F.create_map(*(x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(k)))))
    rows = rows.withColumn("label", number[F.col("family")]).withColumn("row", F.xxhash64("family", "words"))
    rows = settle(rows.select("row", "label", "fold", "words", "hashes"), "license-training")
    fitted = rows.where("fold > 0").withColumn("terms", F.transform("hashes", lambda h: h.cast("string")))
    vectors = CountVectorizer(inputCol="terms", outputCol="x", minDF=3, binary=True, vocabSize=50_000).fit(fitted)
    logistic = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.0015, elasticNetParam=0.5, maxIter=60)
    found = logistic.fit(vectors.transform(fitted).select("x", "label"))
    n, matrix = len(families), found.coefficientMatrix.toArray()
    pad = n - matrix.shape[0]  # classes without a training row come last
    templates = _template_hashes(spark)
    rows_of = {int(t): [*map(float, matrix[:, k]), *[0.0] * pad] for k, t in enumerate(vectors.vocabulary) if matrix[:, k].any()}
    held_by: dict[int, list[int]] = {}
    for j, (_, runs) in enumerate(templates):
        for h in runs:
            held_by.setdefault(h, [0] * len(templates))[j] = 1
    table = [(t, *rows_of.get(t, [0.0] * n), *held_by.get(t, [0] * len(templates))) for t in {**rows_of, **held_by}]
    names = ", ".join([*(f"w{k} double" for k in range(n)), *(f"t{j} int" for j in range(len(templates)))])
    weights = spark.createDataFrame(table, f"term long, {names}")
    biases = [*map(float, found.interceptVector.toArray()), *[-50.0] * pad]
    held = rows.where("fold = 0").dropDuplicates(["row"])
    sums = held.select("row", F.explode("hashes").alias("hash"))
    sums = held.select("row", "label").join(_summed(sums, F.broadcast(weights), n, "row"), "row", "left").withColumn("k", F.col("label").cast("int") + 1)
    grid = [0.5, 0.7, 1.0, 1.4, 2.0]
    share = lambda t: _share(_margins(biases, t), F.element_at(_margins(biases, t), F.col("k")))
    loss = sums.agg(*(F.sum(-F.log(share(t) + 1e-12)).alias(str(i)) for i, t in enumerate(grid))).first()
    temperature = min(zip([x if x is not None else 0.0 for x in loss], grid, strict=True))[1]
    return Model(weights, biases, temperature, [(f, len(runs)) for f, runs in templates], _lifts(fitted, rows_of), [*held_by])


def scan(docs: DataFrame, model: Model | None = None, least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """``doc_id, place, family, probability, similarity, confirmed`` of the paragraphs that get a family.

    ``place`` counts lines from 0 and is the first one of a notice that is wrapped over several; ``similarity`` is the largest share of the runs of one of
    the family's templates that the paragraph holds.
    """
    model = model or train(docs)
    families, weights = _families(), model.weights
    if weights.count() <= BROADCAST:
        weights = F.broadcast(weights)
    # The number tells rows apart within this one aggregation only.
    key = ("rid", "doc_id", "place", "nth", "wrapped")
    lines = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    lines = _windows(lines, model.runs if confirm > 0 else None, "rid", "doc_id").where(_may_have_family(F.col("words"), model))
    hashes = F.concat(term_hashes(F.col("words")), run_hashes(F.col("words")))
    rows = lines.select(*key, F.explode(hashes).alias("hash")).join(weights, F.col("hash") == F.col("term"))
    summed = rows.groupBy(*key).agg(
        *(F.sum(f"w{k}").alias(f"s{k}") for k in range(len(families))), *(F.sum(f"t{j}").alias(f"h{j}") for j in range(len(model.sizes)))
    )
    alike = {f: [F.col(f"h{j}") / n for j, (g, n) in enumerate(model.sizes) if f == g] for f in families}
    alike = F.array(*(F.greatest(F.lit(0.0), *alike[f]) if alike[f] else F.lit(0.0) for f in families))
    scored = summed.select(*key, _margins(model.biases, model.temperature).alias("m"), alike.alias("alike")).withColumn("top", F.array_max("m"))
    scored = scored.withColumn("probability", _share(F.col("m"), F.col("top"))).withColumn("k", F.array_position("m", F.col("top")).cast("int"))
    names = F.array(*(F.lit(f) for f in families))
    scored = scored.withColumn("family", F.element_at(names, F.col("k"))).withColumn("similarity", F.element_at("alike", F.col("k")))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    scored = scored.where(~F.col("wrapped") | (F.col("similarity") >= confirm))
    # A window counts where no line or window beside it holds more of the notice; of equal ones the last, which starts in it.
    near = Window.partitionBy("rid", "family").orderBy("nth")
    here = Window.partitionBy("rid", "family", "nth")
    for name, at in (("beyond", 1), ("earlier", -1)):
        scored = scored.withColumn(name, F.coalesce(F.max("similarity").over(near.rangeBetween(at, at)), F.lit(0.0)))
    scored = scored.withColumn("line", F.coalesce(F.max(F.when(~F.col("wrapped"), F.col("similarity"))).over(here), F.lit(0.0)))
    scored = scored.where(~F.col("wrapped") | ((F.col("similarity") > F.greatest("beyond", "line")) & (F.col("similarity") >= F.col("earlier"))))
    scored = scored.withColumn("replaced", F.max("wrapped").over(here)).where(F.col("wrapped") | ~F.col("replaced"))
    return scored.select("doc_id", "place", "family", "probability", "similarity", (F.col("similarity") >= confirm).alias("confirmed"))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
