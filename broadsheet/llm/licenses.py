"""Licence scan by a trained paragraph classifier.

Paragraphs are lines, and lines put together where a sentence goes on over line ends. They
are turned into hashed one- and two-word features; a sparse multinomial logistic
regression, trained on licence notices and on paragraphs of the corpus, gives each
family's probability. What counts as unknown is calibrated on all lines of the corpus. A
paragraph that is taken for a licence, or that has word pairs without which no template
can be confirmed, is compared with the templates of all families. A template confirms it
if the paragraph has most of the template's word pairs and the family's telling words, not
negated and not those of a sibling. Column functions and the DataFrame-based learning
library only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import let
from broadsheet.llm.samples import least_hashed
from broadsheet.llm.scratch import Scratch

SAMPLE = 600  # documents whose paragraphs teach what is no licence, about
LEARNED = 12_000  # paragraphs of these documents, chosen by hash from whole texts, at most
HASHES = 1 << 14
CONFIRMED = 0.8  # share of a template's word pairs that a paragraph must have
FALSE_ALARMS = 0.001  # share of the corpus's paragraphs that the calibration lets pass unconfirmed
LEAST = 0.5  # threshold, at least

UNKNOWN = "unknown"
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "MPL-1.1": [
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: MPL-1.1",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": ["Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Public domain": [
        "This work is dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "All rights reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
}

# Telling words: patterns over lower-case words with one space around each and STOP where a sentence ends.
STOP = "\x01"
_SPDX = " spdx license identifier "
_BY = " (?:creative commons attribution|cc by) "
_NC, _SA, _ND = "(?:non ?commercial|nc) ", "(?:share ?alike|sa) ", "(?:no ?deriv[a-z]*|nd) "
_VERSION = f"(?:{STOP} )?(?:version |v )?(?:{STOP} )?"
TELLING = {
    "Apache-2.0": f" apache licen[cs]e {_VERSION}2 |{_SPDX}apache 2 ",
    "MIT": f" mit licen[cs]e | this software and associated documentation files |{_SPDX}mit (?!0 )",
    "GPL": f" gnu general public licen[cs]e |{_SPDX}gpl ",
    "LGPL": f" gnu (?:lesser|library) general public licen[cs]e |{_SPDX}lgpl ",
    "AGPL": f" gnu affero general public licen[cs]e |{_SPDX}agpl ",
    "BSD": f" bsd licen[cs]e | redistribution and use in source and binary forms |{_SPDX}bsd ",
    "ISC": f" isc licen[cs]e | distribute this software for any purpose with or without fee is hereby granted |{_SPDX}isc ",
    "MPL-2.0": f" mozilla public licen[cs]e {_VERSION}2 |{_SPDX}mpl 2 ",
    "MPL-1.1": f" mozilla public licen[cs]e {_VERSION}1 1 |{_SPDX}mpl 1 1 ",
    "EPL": f" eclipse public licen[cs]e |{_SPDX}epl ",
    "CC-BY-NC": f"{_BY}{_NC}(?!{_SA}|{_ND})",
    "CC-BY-NC-SA": f"{_BY}{_NC}{_SA}",
    "CC-BY-NC-ND": f"{_BY}{_NC}{_ND}",
    "CC-BY-SA": f"{_BY}{_SA}",
    "CC-BY-ND": f"{_BY}{_ND}",
    "CC-BY": f"{_BY}(?!{_NC}|{_SA}|{_ND})",
    "CC0": f" cc0 1 |{_SPDX}cc0 ",
    "Unlicense": f" unencumbered software released into the public domain |{_SPDX}unlicense ",
    "Public domain": " dedicated to the public domain | waived all copyright ",
    "All rights reserved": " all rights reserved ",
}
# A negation up to five words before the telling words, in the same sentence, takes them back.
_DENIED = r"(?<! (?:not|never|neither|nor|cannot|no longer|[a-z]{2,6}n t)" + r"(?: [\p{L}\p{N}]{1,24})?" * 5 + ")"

_BLANK = r"^[^\p{L}\p{N}]*$"
_MARKS = r"^(?:\s*(?://+!?|/\*+|\*+/?|#+!?|;+|--+|<!--+|%+|>+|\|+|(?i:rem|dnl)(?=\s|$)))+\s?"
_ENDS = r"""[.!?]["'\u2019\u201D)\]]*\s*(?:\*+/?|--+>|#+|\|+)?\s*$"""
_GOES_ON = r"^[^\p{L}\p{N}]*[\p{Ll}\p{N}]"
_IDENTIFIER = "SPDX-License-Identifier:"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(tokens: Column) -> Column:
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), size), F.slice(tokens, F.lit(2), size), lambda a, b: F.concat_ws(" ", a, b))


def _features(rows: DataFrame) -> DataFrame:
    """Add ``grams`` and the hashed vector of words and word pairs."""
    grams = rows.withColumn("grams", let(_words(F.col("paragraph")), lambda tokens: F.concat(tokens, _pairs(tokens))))
    return HashingTF(numFeatures=HASHES, binary=True, inputCol="grams", outputCol="features").transform(grams)


def _own_pairs(notice: str) -> list[str]:
    """Different word pairs of a template."""
    tokens = re.findall(r"[^\W_]+", notice.lower())
    return sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:])})


def _needed_pairs() -> list[str]:
    """Word pairs of the templates of which a paragraph has at least one if a template confirms it."""
    needed = set()
    for notice in (n for notices in TEMPLATES.values() for n in notices):
        own = sorted(_own_pairs(notice), key=lambda pair: (-len(pair), pair))
        needed.update(own[: len(own) - math.ceil(CONFIRMED * len(own) - 1e-9) + 1])
    return sorted(needed)


def _spoken(text: Column) -> Column:
    """Lower-case words with one space around each, and STOP where a sentence ends."""
    stops = F.regexp_replace(F.lower(text), r"""[.!?]+["')\]]*(?=\s|$)""", f" {STOP} ")
    return F.concat(F.lit(" "), F.regexp_replace(stops, rf"[^\p{{L}}\p{{N}}{STOP}]+", " "), F.lit(" "))


def _told(spoken: Column, family: str) -> Column:
    """Whether the words hold the family's telling words without a negation before them."""
    return F.coalesce(spoken.rlike(f"(?={TELLING[family]}){_DENIED}"), F.lit(False))


def _units(text: Column) -> Column:
    """first, lines: the lines of a text, those together over whose ends a sentence goes on.

    A unit ends before and after a line without words and a licence identifier, and at a full
    stop, unless the next line goes on in lower case or with a number.
    """

    def bounds(lines: Column) -> Column:
        def ends(i: Column) -> Column:
            own, after = F.get(lines, i), F.get(lines, i + 1)
            apart = own.rlike(_BLANK) | after.rlike(_BLANK) | own.contains(_IDENTIFIER) | after.contains(_IDENTIFIER)
            return after.isNull() | apart | (own.rlike(_ENDS) & ~F.regexp_replace(after, _MARKS, "").rlike(_GOES_ON))

        def cut(last: Column) -> Column:
            def unit(end: Column, k: Column) -> Column:
                first = F.when(k > 0, F.get(last, k - 1) + 1).otherwise(0)
                return F.struct(first.alias("first"), F.slice(lines, first + 1, end - first + 1).alias("lines"))

            return F.transform(last, unit)

        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), ends), cut)

    return let(F.split(text, "\n", -1), bounds)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, place, last_place, unit, paragraph, around: lines that hold a word, and lines that go on, put together.

    ``place`` and ``last_place`` are the numbers of the first and last line, ``unit`` that of
    the first line of those put together. ``around`` is the line with its neighbours in the
    unit. Lines put together have no comment marks.
    """
    units = docs.filter("text is not null").select("doc_id", F.explode(_units(F.col("text"))).alias("u"))

    def pieces(u: Column) -> Column:
        first, lines = u["first"], u["lines"]

        def piece(line: Column, i: Column) -> Column:
            near = F.concat_ws(" ", F.regexp_replace(F.get(lines, i - 1), _MARKS, ""), F.regexp_replace(line, _MARKS, ""),
                               F.regexp_replace(F.get(lines, i + 1), _MARKS, ""))
            around = F.when(F.size(lines) > 1, near).otherwise(line)
            return F.struct((first + i).alias("place"), (first + i).alias("last_place"), line.alias("paragraph"), around.alias("around"))

        whole = F.concat_ws("\n", F.transform(lines, lambda line: F.regexp_replace(line, _MARKS, "")))
        joined = F.struct(first.alias("place"), (first + F.size(lines) - 1).alias("last_place"), whole.alias("paragraph"), whole.alias("around"))
        return F.when(F.size(lines) > 1, F.concat(F.transform(lines, piece), F.array(joined))).otherwise(F.transform(lines, piece))

    cut = units.select("doc_id", F.col("u.first").alias("unit"), F.explode(let(F.col("u"), pieces)).alias("p"))
    return cut.filter(F.col("p.paragraph").rlike(r"[\p{L}\p{N}]")).select("doc_id", "p.place", "p.last_place", "unit", "p.paragraph", "p.around")


def _corpus_sample(docs: DataFrame, most: int) -> DataFrame:
    """At most ``LEARNED`` paragraphs of about ``most`` documents, from anywhere in their texts, the same ones each time."""
    ids = least_hashed(docs.select("doc_id").filter("doc_id is not null").distinct(), 2 * most, "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)), "doc_id")
    return least_hashed(paragraphs(texts).select("doc_id", "place", "last_place", "paragraph"), LEARNED, "doc_id", "place", "last_place").select("paragraph")


def _examples(spark: SparkSession) -> DataFrame:
    """Templates, whole and in parts, alone and with other words around them."""
    rows = []
    for number, notices in enumerate(TEMPLATES.values()):
        for notice in notices:
            tokens = notice.split()
            parts = [notice] * 4 + ([" ".join(tokens[: -(-len(tokens) * 3 // 4)]), " ".join(tokens[len(tokens) // 4 :])] if len(tokens) > 6 else [])
            rows += [(part, float(number + 1)) for part in parts]
            rows += [(f"{before} {notice} {after}".strip(), float(number + 1)) for before in ("", "Copyright 2020 the authors.") for after in ("", "See the file for details.")]
    return spark.createDataFrame(rows, "paragraph string, label double")


@dataclass
class Model:
    classifier: LogisticRegressionModel
    threshold: float


def _compared(rows: DataFrame) -> DataFrame:
    """Add the best share of a template's word pairs that the paragraph has, and whether that confirms it.

    A confirmed paragraph is of the family whose template it has most of, among those whose
    telling words it has, the likeliest one or the first where several have as much. Others
    are of the likeliest family, with its share, or of none if its telling words are absent.
    """

    def shares(grams: Column, spoken: Column) -> Column:
        found = []
        for number, (family, notices) in enumerate(TEMPLATES.items(), 1):
            best = F.lit(0.0)
            for notice in notices:
                own = _own_pairs(notice)
                best = F.greatest(best, F.size(F.array_intersect(grams, F.array(*[F.lit(pair) for pair in own]))) / F.lit(float(len(own))))
            found.append(F.struct(_told(spoken, family).alias("told"), best.alias("share"), (F.col("family") == family).alias("likeliest"), F.lit(-number).alias("order")))
        return F.array(*found)

    def chosen(found: Column) -> Column:
        most = F.array_max(found)  # one that is told before one that is not
        return F.when(most["told"] & (most["share"] >= CONFIRMED), most).otherwise(F.filter(found, lambda x: x["likeliest"])[0])

    best = rows.withColumn("best", let(F.struct("grams", _spoken(F.col("around")).alias("spoken")), lambda r: let(shares(r["grams"], r["spoken"]), chosen)))
    names = F.array(*[F.lit(name) for name in TEMPLATES])
    return best.select(
        "doc_id", "place", "last_place", "unit",
        F.when(F.col("best.told"), F.element_at(names, -F.col("best.order"))).otherwise(UNKNOWN).alias("family"),
        F.element_at("chances", -F.col("best.order")).alias("probability"), F.col("best.share").alias("similarity"),
        (F.col("best.told") & (F.col("best.share") >= CONFIRMED)).alias("confirmed"), "probability_of_family")


def _classified(rows: DataFrame, classifier: LogisticRegressionModel) -> DataFrame:
    """Add the likeliest family and its probability; ``unknown`` is no family."""
    scored = classifier.transform(_features(rows))
    chances = F.slice(vector_to_array("probability"), 2, len(TEMPLATES))
    top = scored.withColumn("chances", chances).withColumn("probability_of_family", F.array_max("chances"))
    names = F.array(*[F.lit(name) for name in TEMPLATES])
    return top.withColumn("family", F.element_at(names, F.array_position("chances", F.col("probability_of_family")).cast("int")))


def _train(docs: DataFrame, most: int) -> LogisticRegressionModel:
    """Train on the templates and on paragraphs of about ``most`` documents."""
    spark = docs.sparkSession
    scratch = Scratch(docs, "licences")
    sample = scratch.keep(_corpus_sample(docs, most))
    examples = _examples(spark)
    keywords = F.lower("paragraph").rlike("licen[cs]e|copyright|all rights reserved|public domain|redistribution")
    plain = sample.filter(~keywords).select("paragraph", F.lit(0.0).alias("label"))
    plain = plain.unionByName(spark.createDataFrame([("the of and to in is this that for with", 0.0)], "paragraph string, label double"))
    training = _features(examples.unionByName(plain)).select("features", "label")
    learner = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=40)
    classifier = learner.fit(training.coalesce(4))
    scratch.drop(sample)
    return classifier


def _candidates(docs: DataFrame, classifier: LogisticRegressionModel, least: float = LEAST) -> DataFrame:
    """Compared lines whose probability reaches ``least``, and paragraphs that a template confirms."""
    scratch = Scratch(docs, "licences")
    found = _classified(paragraphs(docs), classifier)
    near = F.arrays_overlap("grams", F.array(*[F.lit(pair) for pair in _needed_pairs()]))
    likely = (F.col("probability_of_family") >= least) & (F.col("place") == F.col("last_place"))
    # Written, since a filter on what is compared would otherwise classify anew for every family.
    few = scratch.keep(found.filter(likely | near).select(
        "doc_id", "place", "last_place", "unit", "paragraph", "around", "family", "chances", "probability_of_family"))
    compared = _compared(few.withColumn("grams", _pairs(_words(F.col("paragraph")))))
    kept = scratch.keep(compared)
    scratch.drop(few)
    return kept.filter(likely | F.col("confirmed"))


def _outer_once(rows: DataFrame) -> DataFrame:
    """Leave out lines put together of which one alone is confirmed for the same family."""
    alone = rows.filter("confirmed and place = last_place").select(F.col("doc_id").alias("id"), F.col("unit").alias("at"), F.col("family").alias("of")).distinct()
    joined = rows.filter("place < last_place")
    same = joined["doc_id"].eqNullSafe(alone["id"]) & (joined["unit"] == alone["at"]) & (joined["family"] == alone["of"])
    return rows.filter("place = last_place").unionByName(joined.join(alone, same, "left_anti"))


def _lines(docs: DataFrame) -> int:
    """Number of lines that hold a word."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda line: line.rlike(r"[\p{L}\p{N}]"))
    return docs.agg(F.sum(F.greatest(F.size(lines), F.lit(0))).alias("n")).first()["n"] or 0


def _threshold(docs: DataFrame, candidates: DataFrame) -> float:
    """The probability that all but ``FALSE_ALARMS`` of the unconfirmed lines stay under, from those that reach ``LEAST``."""
    counts = candidates.agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("unsure")).first()
    allowed = int(FALSE_ALARMS * (_lines(docs) - counts["confirmed"]))
    if counts["unsure"] <= allowed:
        return LEAST
    unsure = candidates.filter(~F.col("confirmed"))
    level = unsure.agg(F.percentile_approx("probability_of_family", 1 - allowed / counts["unsure"], 10_000).alias("level")).first()["level"]
    return min(max(math.nextafter(level, 1.0), LEAST), 0.99)  # those at the level are not under it


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Train on the templates and on paragraphs of about ``most`` documents; calibrate on all paragraphs.

    The threshold is the probability that all but ``FALSE_ALARMS`` of the corpus's paragraphs
    stay under, those aside that a template confirms; one half at least.
    """
    classifier = _train(docs, most)
    threshold = _threshold(docs, _candidates(docs, classifier).filter("place = last_place"))
    return Model(classifier, threshold)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, place, last_place, family, probability, similarity, confirmed: one row for each paragraph that states a licence.

    ``docs``: doc_id, text; other columns are not read. Lines are numbered from 0; a paragraph
    reaches from line ``place`` to ``last_place``. Rows are lines whose probability of a family
    reaches the model's threshold, confirmed or not by a template, and lines, or lines put
    together where a sentence goes on over their ends, that a template of any family confirms;
    these have the probability of that family. Unconfirmed lines without the telling words of
    their likeliest family are of the family ``unknown``; so are negated notices.
    Null, empty and blank texts have no paragraphs; documents without licences have no
    rows; rows that repeat a document are reported each. Empty tables give an empty result.
    Without a model, one is fitted to ``docs``, whose paragraphs are classified once for both.
    """
    if model is None:
        candidates = _candidates(docs, _train(docs, SAMPLE))
        threshold = _threshold(docs, candidates.filter("place = last_place"))
    else:
        candidates, threshold = _candidates(docs, model.classifier, model.threshold), model.threshold
    kept = _outer_once(candidates.filter((F.col("probability_of_family") >= threshold) | F.col("confirmed")))
    return kept.select(
        "doc_id", "place", "last_place", "family", F.round("probability", 6).alias("probability"), "similarity", "confirmed")
