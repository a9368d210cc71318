"""Licence scan: a trained paragraph classifier, in DataFrame functions and
Spark ML alone.

A multinomial logistic regression over word n-grams is fitted on notices of
each licence family, on variants of them with words left out, and on sentences
of an ``unknown`` class. Scored are all paragraphs that hold one of ``ANCHORS``
and all others that a notice could confirm. The search for these loses none:
whoever holds enough words of a notice holds one of any set of its words that is
larger than the rest (``signs``). Scores are sums of joined n-gram weights. A family's threshold is calibrated on held-out variants: above
every probability that it gets on unknown ones. A prediction is confirmed if
``CONFIRMED`` of the words of one of the family's notices are in the paragraph.

A paragraph is a line, or a sentence over several lines: runs of non-blank
lines, comment marks stripped, are joined by spaces and cut into sentences, so a
notice wrapped at any width is compared as a whole. A wrapped sentence counts if
it is confirmed and none of its lines is by itself; it stands for its lines.

Defined cases: null and empty texts have no paragraph that counts; paragraphs
are of any length and named by their first line; repeated rows repeat their results;
null ids are carried along; of equal scores the family first by name is
predicted; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import written

UNKNOWN = "unknown"
GRAMS = 3
#: Variants of each training sentence: the documented bound of the fit.
VARIANTS = 24
CONFIRMED = 0.6
LEAST = 0.5

#: Parts of words that tell of rights in a work.
ANCHORS = ["licen", "copyright", "permission", "warrant", "redistribut", "apache", "gnu", "gpl", "bsd", "mozilla",
           "creative", "cc0", "public domain", "spdx", "unlicense"]

#: Marks at the start of a comment's line.
COMMENT = r"^ *(?:/\*+!?|\*+/|\*+|//+!?|#+!?|--+|;+|%+|<!--+|\"{3}|'{3}|dnl |REM )*+"
#: The mark at the end of a comment's line. A run of spaces or stars is entered at its first sign alone.
END_MARK = r"(?<! ) *+(?:(?<!\*)\*++/|-->) *+$"
#: A blank line's mark, or the end of a sentence before a capital letter.
SENTENCE_END = r"(?<! ) *+\x03[ \x03]*+|(?<=[.!?]) +(?=(?:\x01\d+\x02)?[\"'(]?\p{Lu})"

#: Published notices of licence families.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0"],
    "creative commons": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).",
        "This work is dedicated to the public domain."],
    "proprietary": [
        "Copyright (c) 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "This software is proprietary and confidential; unauthorised copying is prohibited without a licence."],
}

#: Words of notices that are frequent in any text.
PLAIN = set("""a an and any are as at be by can either express following for free from have in is it must not of on or
 part shall should subject that the this to under use was with work you your""".split())

#: Sentences with the same words that state no licence.
OTHERS = [
    "You need a valid driving licence to rent a car here.",
    "Her licence to practise medicine was renewed last spring.",
    "The copyright office opened its doors on a cold morning.",
    "With the permission of the mayor they crossed the old bridge.",
    "Police obtained a warrant to search the building.",
    "The warranty on the washing machine has expired.",
    "They redistributed the land among the farmers of the valley.",
    "The Apache helicopter landed near the village.",
    "A gnu crossed the river with the herd.",
    "He is a creative person with many ideas.",
    "The fishing licence costs twenty a year and the permission is local.",
    "Lawyers disagree about copyright in general and about fair use.",
    "The song entered the public domain debate on the radio.",
    "Poetic licence lets her bend the rules of grammar.",
    "The pub lost its licence after the public hearing.",
    "Pupils need the written permission of a parent.",
]


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}.+-]+|\.(?= |$)"), lambda w: w != "")


def grams(own: str) -> Column:
    """The distinct n-grams, up to ``GRAMS`` words, of a column of words."""
    def runs(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1))),
                             lambda at: F.array_join(F.slice(own, at, n), " "))
        return F.when(F.size(own) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAMS + 1)]))


def holds_anchor(c: Column) -> Column:
    low = F.lower(c)
    found = low.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        found = found | low.contains(anchor)
    return found


def notice_words() -> list[list[str]]:
    """The distinct words of each notice, as ``words`` finds them."""
    found = [re.split(r"[^\w.+-]+|\.(?= |$)", s.lower()) for own in NOTICES.values() for s in own]
    return [list(dict.fromkeys(w for w in own if w)) for own in found]


def signs() -> list[str]:
    """Words of which each paragraph that could be confirmed holds one: of each
    notice one more than may be missing, the plain words last."""
    out = set()
    for own in notice_words():
        least = next(n for n in range(len(own) + 1) if n / len(own) >= CONFIRMED)
        out.update(sorted(own, key=lambda w: (w in PLAIN, -len(w), w))[:len(own) - least + 1])
    return sorted(out)


def holds_sign(own: Column) -> Column:
    return F.arrays_overlap(own, F.array(*[F.lit(w) for w in signs()]))


def of_notices(own: Column) -> Column:
    """The distinct words of a column of words that any notice has."""
    return F.array_intersect(own, F.array(*[F.lit(w) for w in sorted({w for n in notice_words() for w in n})]))


def confirmable(own: Column) -> Column:
    """Whether a column of ``of_notices`` holds enough of any notice."""
    notices = F.array(*[F.array(*[F.lit(w) for w in n]) for n in notice_words()])
    return holds_sign(own) & F.exists(notices, lambda n: F.size(F.array_intersect(own, n)) / F.size(n) >= CONFIRMED)


def sentences(text: str) -> Column:
    """The sentences of a text that stand on several lines, as structs of
    ``paragraph`` and ``last``, their first and last line, and ``line``, the
    joined words."""
    strip = lambda line: F.trim(F.regexp_replace(F.regexp_replace(
        F.translate(line, "\r\t\x01\x02\x03", "  "), COMMENT, ""), END_MARK, ""))
    # each line begins with its number between marks; a blank one is a mark of its own
    marked = F.transform(F.split(F.col(text), "\n"), lambda line, k: F.when(strip(line) == "", F.lit("\x03")).otherwise(
        F.concat(F.lit("\x01"), k.cast("string"), F.lit("\x02"), strip(line))))
    cut = F.split(F.array_join(marked, " "), SENTENCE_END)
    over = F.filter(cut, lambda s: s.rlike(r"(?s).\x01"))
    number = lambda s, pattern: F.regexp_extract(s, pattern, 1).cast("int")
    return F.transform(over, lambda s: F.struct(
        F.when(s.startswith("\x01"), number(s, r"^\x01(\d+)")).otherwise(number(s, r"\x01(\d+)") - 1).alias("paragraph"),
        number(s, r"(?s).*\x01(\d+)").alias("last"), F.regexp_replace(s, r"\x01\d+\x02", "").alias("line")))


def training_rows(spark: SparkSession) -> DataFrame:
    """``family, sentence, fold``: each notice and sentence whole and in
    variants with a tenth to four tenths of its words left out by hash."""
    known = [(family, s) for family, own in NOTICES.items() for s in own] + [(UNKNOWN, s) for s in OTHERS]
    rows = spark.createDataFrame(known, "family string, sentence string")
    variant = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    keep = lambda w, at: F.pmod(F.xxhash64(w, at, F.col("variant")), F.lit(100)) >= F.pmod(
        F.col("variant"), F.lit(5)) * 10
    left = F.array_join(F.filter(F.split("sentence", " "), keep), " ")
    return variant.select("family", left.alias("sentence"), F.pmod("variant", F.lit(3)).alias("fold")).where("sentence != ''")


class Classifier:
    """The fitted weights: small tables of the features' number."""

    def __init__(self, weights: list[tuple], intercepts: dict[str, float], thresholds: dict[str, float]):
        self.weights, self.intercepts, self.thresholds = weights, intercepts, thresholds

    def scores(self, paragraphs: DataFrame, key: list[str]) -> DataFrame:
        """``key, family, probability`` of the likeliest family of each row of
        ``words``; with no known n-gram, no row."""
        spark = paragraphs.sparkSession
        table = spark.createDataFrame(self.weights, "gram string, weights array<double>")
        names = sorted(self.intercepts)
        found = (paragraphs.select(*key, F.explode(grams("words")).alias("gram"))
                 .join(F.broadcast(table), "gram"))  # as many rows as the training sentences have n-grams
        sums = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(len(names))]
        logits = [F.exp(F.col(f"s{k}") + self.intercepts[name]) for k, name in enumerate(names)]
        total = sum(logits[1:], logits[0])
        best = F.array_max(F.array(*[F.struct((x / total).alias("p"), F.lit(-k).alias("rank"), F.lit(n).alias("family"))
                                     for k, (x, n) in enumerate(zip(logits, names))]))
        return (found.groupBy(*key).agg(*sums).select(*key, best.alias("best"))
                .select(*key, F.col("best.family").alias("family"), F.col("best.p").alias("probability")))


def train(spark: SparkSession) -> Classifier:
    rows = written(training_rows(spark).withColumn("words", words(F.col("sentence"))), "licence-words")
    rows = written(rows.withColumn("grams", grams("words")).coalesce(1), "licence-training")
    names = sorted({*NOTICES, UNKNOWN})
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1

    def fitted(part: DataFrame, thresholds: dict[str, float]) -> Classifier:
        vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(part)
        model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60).fit(
            vectors.transform(part.withColumn("label", label.cast("double"))).select("label", "features"))
        matrix = model.coefficientMatrix.toArray()
        weights = [(gram, [float(x) for x in matrix[:, k]]) for k, gram in enumerate(vectors.vocabulary)]
        return Classifier(weights, dict(zip(names, map(float, model.interceptVector))), thresholds)

    held_out = rows.where("fold = 2").withColumn("id", F.monotonically_increasing_id())
    first = fitted(rows.where("fold != 2"), {})
    wrong = (first.scores(held_out.where(F.col("family") == UNKNOWN).drop("family"), ["id"])
             .where(F.col("family") != UNKNOWN).groupBy("family").agg(F.max("probability").alias("p")).collect())
    above = {r["family"]: r["p"] for r in wrong}  # one row per family
    return fitted(rows, {n: min(0.95, max(LEAST, above.get(n, 0.0) + 0.05)) for n in names if n != UNKNOWN})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that holds an anchor or enough words of a notice: id, ``paragraph`` (0-based
    number of its first line), ``family`` (``unknown`` below the threshold),
    ``probability``, ``similarity`` to the nearest notice of the family,
    ``confirmed``."""
    spark = docs.sparkSession
    low = F.lower(F.col(f"`{text_col}`"))
    # an anchor of two words can be wrapped as well
    texts = (docs.where(holds_anchor(F.col(f"`{text_col}`")) | (low.contains("public") & low.contains("domain"))
                        | holds_sign(words(F.translate(F.col(f"`{text_col}`"), "\r\n\t", "   "))))
             .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
             .withColumn("doc", F.monotonically_increasing_id()))
    alone = F.transform(F.split("text", "\n"), lambda line, k: F.struct(
        k.alias("paragraph"), k.alias("last"), line.alias("line")))
    # a line's words of notices are found once, within the generated column
    known = F.transform(F.concat(alone, sentences("text")), lambda p: F.struct(p["paragraph"], p["last"], p["line"], F.when(
        ~holds_anchor(p["line"]), of_notices(words(p["line"]))).alias("some")))
    lines = (texts.select("id", "doc", F.explode(known).alias("p")).select("id", "doc", "p.*")
             .where(F.col("some").isNull() | confirmable(F.col("some"))).drop("some")
             .withColumns({"row": F.monotonically_increasing_id(), "words": words(F.col("line"))}))
    lines = written(lines, "licence-paragraphs")
    model = train(spark)
    threshold = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    scored = written(model.scores(lines, ["row"]), "licence-scores").withColumn(
        "family", F.when(F.col("probability") >= threshold[F.col("family")], F.col("family")).otherwise(UNKNOWN))
    notices = spark.createDataFrame([(f, s) for f, own in NOTICES.items() for s in own], "family string, notice string")
    notices = notices.select("family", F.array_distinct(words(F.col("notice"))).alias("notice"))
    sure = lines.join(scored, "row").withColumn("words", F.array_distinct("words"))
    likeness = F.size(F.array_intersect("words", "notice")) / F.size("notice")
    near = (sure.join(F.broadcast(notices), "family")  # a fixed table
            .groupBy("row").agg(F.max(likeness).alias("similarity")))
    found = written(lines.join(scored, "row", "left").join(near, "row", "left").select(
        "id", "doc", "row", "paragraph", "last", F.coalesce("family", F.lit(UNKNOWN)).alias("family"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        (F.coalesce("similarity", F.lit(0.0)) >= CONFIRMED).alias("confirmed")), "licence-found")
    single = found.where("paragraph = last")
    wrapped = found.where("paragraph < last and confirmed")
    on_lines = wrapped.select("row", "doc", "family", F.explode(F.sequence("paragraph", "last")).alias("paragraph"))
    known = on_lines.join(single.where("confirmed").select("doc", "family", "paragraph"), ["doc", "family", "paragraph"])
    wrapped = wrapped.join(known.select("row").distinct(), "row", "left_anti")
    parts = on_lines.join(wrapped.select("row"), "row", "left_semi").select("doc", "paragraph").distinct()
    rest = single.where("not confirmed").join(parts, ["doc", "paragraph"], "left_anti")
    columns = [F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "family", "probability",
               "similarity", "confirmed"]
    return (single.where("confirmed").select(*columns).unionByName(wrapped.select(*columns))
            .unionByName(rest.select(*columns)))
