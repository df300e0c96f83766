"""License scans by an exact set-similarity join (DataFrame functions only).

Templates are notices, taken as sets of words. A template of n words is looked for in blocks of 2s consecutive words, one
beginning at every s-th word of a text, with s the next power of two from n (8 at least); so every s consecutive words lie whole in
some block, wherever lines or paragraphs end. A block qualifies when it holds at least `threshold` of the template's
distinct words, and all of them if they are fewer than SHORT, where one word more or less makes another license. Words are put in one global order, rarest in the
corpus first. A qualifying block must hold one of a template's first |T| - need + 1 words (prefix filter), at
least `need` template words (length filter), and enough words after the first shared one on both sides (positional
filter). Pairs that pass are verified on the whole sets, so none is lost and none is wrong.

Texts are split into words once, on the way into a table that keeps those whose words could meet some template at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_rows, text_or_empty, written

#: Fixed values of the scan: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by which texts state a license, and paragraphs of license texts, by label.
TEMPLATES = {
    "agpl": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU Affero General Public License version 3",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "artistic": ("licensed under the Artistic License 2.0",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD License",
    ),
    "bsl": ("Distributed under the Boost Software License, Version 1.0.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License",),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "reserved": ("All rights reserved",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
THRESHOLD = 0.8
#: Templates of fewer distinct words must be held whole.
SHORT = 10
LEAST_BLOCK = 8
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _joined(text: Column) -> Column:
    """The words of text, A-Z lower-cased, joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NON_WORD, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NON_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _prepared(templates: Mapping[str, Sequence[str]], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words, words needed, step of blocks) of each template that has words."""
    out = []
    for label, texts in sorted(templates.items()):
        for text in texts:
            words = template_words(text)
            if words:
                distinct, n = sorted(set(words)), len(words)
                need = len(distinct) if len(distinct) < SHORT else math.ceil(threshold * len(distinct) - 1e-9)
                out.append((label, distinct, max(1, need), max(LEAST_BLOCK, 1 << (n - 1).bit_length())))
    return out


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _possible_steps(held: Column, prepared: list[tuple[str, list[str], int, int]]) -> Column:
    """The block steps of the templates of which a text with these distinct template words could hold enough."""
    each = [F.when(F.size(F.array_intersect(held, _literals(words))) >= need, F.lit(step)) for _, words, need, step in prepared]
    return F.array_compact(F.array_distinct(F.array(*each)))


def word_order(held: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The templates' words, those in the fewest rows of held(words) first, ties by code point.

    Counted over all rows; the result has a row per template word, so the templates bound what reaches the driver.
    """
    n = {r["word"]: r["count"] for r in held.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def template_blocks(texts: DataFrame, order: Sequence[str], prepared: list[tuple[str, list[str], int, int]]) -> DataFrame:
    """Pairs of a block and a template that meet the threshold: row_key, step, block (its number), label, template (its number), containment.

    texts has row_key, joined (the words, lower-cased, with single spaces between) and steps (see _possible_steps).
    """
    rank = {w: i for i, w in enumerate(order)}
    ordered = [sorted(rank[w] for w in words) for _, words, _, _ in prepared]
    prefixes = [(r, i, k, step, need, t, label) for k, ((label, _, need, step), t) in enumerate(zip(prepared, ordered)) for i, r in enumerate(t[: len(t) - need + 1])]
    side = literal_rows(texts.sparkSession, prefixes, "rank int, at int, template int, step int, need int, words array<int>, label string")
    known, ranks = _literals(order), F.map_from_arrays(_literals(order), _literals(range(len(order))))
    rows = texts.select("row_key", F.split("joined", " ").alias("all"), F.explode("steps").alias("step"))
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - 2 * F.col("step")) / F.col("step"))).cast("int")
    rows = rows.select("row_key", "step", "all", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    inside = F.array_intersect(F.slice("all", F.col("block") * F.col("step") + 1, 2 * F.col("step")), known)
    rows = rows.select("row_key", "step", "block", F.array_sort(F.transform(inside, lambda w: ranks[w])).alias("held"))
    pairs = rows.select("*", F.posexplode("held").alias("held_at", "rank")).join(F.broadcast(side), ["rank", "step"])
    pairs = pairs.where("size(held) >= need AND least(size(words) - at, size(held) - held_at) >= need")
    pairs = pairs.dropDuplicates(["row_key", "step", "block", "template"])
    common = F.size(F.array_intersect("held", "words"))
    return pairs.where(common >= F.col("need")).select("row_key", "step", "block", "label", "template", (common / F.size("words")).alias("containment"))


def license_report(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base counts every place of a phrase, by word; labels joins the base's labels with those of matched
    templates. score is 1 where a phrase stands, else the greatest containment of a matched template, else 0.
    Null text: no words. Repeated rows: each reported. Null doc_id: kept. Empty input: no rows. Other columns of
    docs are ignored. Long texts cost in proportion to their length.
    """
    prepared = _prepared(templates, threshold)
    vocabulary = sorted({w for _, words, _, _ in prepared for w in words})
    padded = docs.select("doc_id", F.concat(F.lit(" "), _joined(text_or_empty()), F.lit(" ")).alias("padded"))
    n_words = F.when(F.col("padded") == "  ", F.lit(0)).otherwise(_spaces(F.col("padded")) - 1).cast("long")
    padded = padded.withColumn("n_words", n_words)
    zero, places = F.lit(0), []
    for phrase, label in PHRASES.items():
        mark = f" {phrase} "
        held = F.contains(F.col("padded"), F.lit(mark))
        count = F.when(held, F.regexp_count("padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(zero)
        first = F.when(held, _spaces(F.substring_index("padded", mark, 1)))
        last = F.when(held, F.col("n_words") - len(phrase.split()) - _spaces(F.substring_index("padded", mark, -1)))
        places.append(F.struct(F.lit(label).alias("label"), count.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last")))
    joined = F.trim("padded")
    words = F.array_intersect(F.split(joined, " "), _literals(vocabulary)) if vocabulary else F.expr("CAST(array() AS array<string>)")
    rows = padded.select("doc_id", "n_words", F.filter(F.array(*places), lambda p: p["n"] > 0).alias("base"), joined.alias("joined"), words.alias("words"))
    rows = rows.withColumn("steps", _possible_steps(F.col("words"), prepared)) if prepared else rows.withColumn("steps", F.expr("CAST(array() AS array<int>)"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "n_words", "base", F.when(F.size("steps") > 0, F.col("joined")).alias("joined"), "words", "steps"), "words")
    if prepared:
        pairs = template_blocks(rows.where("size(steps) > 0"), word_order(rows, vocabulary), prepared)
    else:
        pairs = literal_rows(docs.sparkSession, [], "row_key long, label string, containment double")
    found = pairs.groupBy("row_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = rows.select("row_key", "doc_id", "n_words", "base").join(found, "row_key", "left")
    labels = F.expr("array_distinct(transform(base, b -> b.label))")
    return out.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(base, 0L, (a, b) -> a + b.n)").alias("n_base"),
        F.expr("array_min(transform(base, b -> b.first))").alias("first_word"),
        F.expr("array_max(transform(base, b -> b.last))").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", F.expr("CAST(array() AS array<string>)")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """SQL for the same rows that compares every block with every template of its step."""
    word = NON_WORD.replace("'", "''")
    values = ", ".join(f"('{label}', {words}, {need}, {step})" for label, words, need, step in _prepared(TEMPLATES, THRESHOLD))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (
  SELECT rid, doc_id, list_filter(string_split_regex(t, '{word}'), lambda x: x <> '') AS words FROM d
), phrases(phrase, label, n) AS (VALUES {phrases}
), places AS (
  SELECT rid, label, unnest(list_filter(range(0, len(words) - n + 1), lambda i: array_to_string(words[i+1:i+n], ' ') = phrase)) AS place
  FROM w, phrases WHERE contains(array_to_string(words, ' '), phrase)
), base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid
), templates(label, words, need, step) AS (VALUES {values}
), known AS (SELECT list(DISTINCT word) AS known FROM (SELECT unnest(words) AS word FROM templates)
), starts AS (
  SELECT rid, step, unnest(range(0, greatest(0, CAST(ceil((len(words) - 2 * step) / step) AS BIGINT)) + 1)) AS b FROM w, (SELECT DISTINCT step FROM templates)
), blocks AS (
  SELECT rid, step, list_intersect(words[b * step + 1 : b * step + 2 * step], known) AS block FROM starts JOIN w USING (rid), known
), found AS (
  SELECT rid, label, need, len(list_intersect(block, templates.words)) AS common, len(templates.words) AS size FROM blocks JOIN templates USING (step) WHERE len(block) >= need
), best AS (
  SELECT rid, list(DISTINCT label) AS labels, max(common / size) AS best FROM found WHERE common >= need GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN best USING (rid)
"""


ORACLE = _oracle()
