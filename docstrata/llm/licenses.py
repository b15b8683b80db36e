"""License scans: exact phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of as many consecutive words as the template has (the rest of the text, if that is shorter); it
may start at any word, whatever the lines. A template matches a block when at least `threshold` of its distinct
words occur in it (containment), among them all words that it demands and none that it forbids: these tell apart
licenses whose statements differ in a word, such as CC BY and CC BY-NC. Words are ordered by their frequency in the
whole corpus, rarest first; a template's prefix in that order must share a word with any block that reaches the
threshold, so texts meet templates by an equi-join on prefix words. Length and position bounds drop
hopeless pairs; blocks are cut around the prefix words of the texts that are left. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower

#: A word: a run of characters other than ASCII that is no letter or digit.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: A label, its statement, words that must occur in a block, words that must not.
Template = tuple[str, str] | tuple[str, str, str, str]

#: Default templates: well-known sentences of public licenses, and the label of each.
TEMPLATES: list[Template] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general 3", ""),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "general 2", ""),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "general 2", ""),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser", ""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4", "noncommercial sharealike noderivatives noderivs"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "by 4", "nc sa nd"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "nc 4", "sa nd"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "sa 4", "nc"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "nd 4", "nc"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "nc sa 4", ""),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", "nc nd 4", ""),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
MAX_TEMPLATES = 10_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LICENSE_WORD), F.lit(0))


def template_index(spark: SparkSession, templates: list[tuple], frequency: dict[str, int], threshold: float) -> DataFrame:
    """word, template, label, at, size, need, length, words, prefix, must, never: a row for each prefix word of each
    template. templates: label, words in order with repeats, words demanded and forbidden."""
    rows = []
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    for number, (label, words, must, never) in enumerate(templates):
        size, prefix = len(set(words)), _prefix(words, frequency, threshold)
        rows += [(w, number, label, at, size, size - len(prefix) + 1, len(words), list(dict.fromkeys(words)), prefix, must, never) for at, w in enumerate(prefix)]
    return spark.createDataFrame(rows, "word string, template int, label string, at int, size int, need int, length int, words array<string>, prefix array<string>, must array<string>, never array<string>")


def _prefix(words: list[str], frequency: dict[str, int], threshold: float) -> list[str]:
    """The rarest distinct words of a template, of which a text with enough of its words has one."""
    ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
    need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
    return ordered[: len(ordered) - need + 1]


def template_words(spark: SparkSession, templates: list[Template]) -> list[tuple]:
    """label, words, demanded and forbidden words of each template, by the same expressions as those of the texts."""
    df = spark.createDataFrame([(i, *t, *("", "")[: 4 - len(t)]) for i, t in enumerate(templates)], "i int, label string, text string, must string, never string")
    lists = [_words(ascii_lower(F.col(c))).alias(c) for c in ("text", "must", "never")]
    found = df.select("i", "label", *lists).orderBy("i").collect()
    return [(r["label"], r["text"], r["must"], r["never"]) for r in found if r["text"]]


def phrase_places(words: Column, low: Column, phrase: str) -> Column:
    """Word numbers at which phrase starts in words. Texts without its first word aren't searched."""
    parts = phrase.split(" ")
    n = len(parts)

    def match(i: Column) -> Column:
        return reduce(Column.__and__, [F.get(words, i + k) == p for k, p in enumerate(parts)])

    present = F.contains(low, F.lit(parts[0])) & (F.size(words) >= n)
    for p in parts[1:]:
        present = present & F.contains(low, F.lit(p))
    none = F.array().cast("array<int>")
    return F.when(present, F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), match)).otherwise(none)


def matching_blocks() -> Column:
    """array<struct<word, label, containment>> of the blocks of a text (words) that match its row's template. A block
    that matches holds a prefix word, and one that starts with a template word holds no fewer of them."""
    n = F.col("length")
    rare = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("prefix", F.get("words", i)))
    before = lambda p: F.filter(F.sequence(F.greatest(p - n + 1, F.lit(0)), p), lambda s: F.array_contains("template_words", F.get("words", s)))
    starts = F.array_distinct(F.flatten(F.transform(rare, before)))

    def block(s: Column) -> Column:
        own = F.slice("words", s + 1, n)
        fits = (F.size(F.array_except("must", own)) == 0) & ~F.arrays_overlap("never", own)
        return F.struct(s.alias("word"), F.col("label").alias("label"), F.when(fits, F.size(F.array_intersect("template_words", own))).otherwise(0).alias("shared"))

    held = F.filter(F.transform(starts, block), lambda b: b["shared"] >= F.col("need"))
    return F.transform(held, lambda b: F.struct(b["word"].alias("word"), b["label"].alias("label"), (b["shared"] / F.col("size")).alias("containment")))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, blocks.

    Base places are where a phrase's words stand consecutively anywhere in the text. blocks lists
    (word, label, containment) of the blocks that match a template and start with one of its words, word being the
    number of that word; labels has the labels of both, distinct, sorted, comma-joined, empty if there are none.
    score is the best containment of a matching block, 1 if a base phrase occurs, else 0. Null and empty
    texts have no words; repeated rows are scanned row by row; an empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    known = template_words(spark, TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for t in known for w in t[1]})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))

    # corpus frequency of the words that templates use: at most len(vocabulary) rows
    listed = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    counts = texts.select(F.explode(F.array_intersect(_words(F.col("low")), listed(vocabulary))).alias("word")).groupBy("word").count().collect()
    frequency = {r["word"]: r["count"] for r in counts}
    index = template_index(spark, known, frequency, threshold)
    ranked = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    prefixes = {w for t in known for w in _prefix(t[1], frequency, threshold)}

    base = texts.withColumn("words", _words(F.col("low"))).withColumn("row", F.monotonically_increasing_id())
    for k, (phrase, _) in enumerate(PHRASES):
        base = base.withColumn(f"p{k}", phrase_places(F.col("words"), F.col("low"), phrase))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    facts = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    base = base.select("row", "doc_id", "low", "words", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base_labels.alias("base_labels"))

    # of each text the template words it holds, rarest first; those of prefixes meet the index
    base = base.withColumn("own", F.array_intersect(listed(ranked), "words"))
    met = F.filter(F.transform("own", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda x: F.array_contains(listed(sorted(prefixes)), x["word"]))
    probes = base.select(*facts, "low", "words", "own", F.explode_outer(met).alias("x")).select(*facts, "low", "words", "own", "x.place", "x.word")
    # the index is bounded by MAX_TEMPLATES
    pairs = probes.join(F.broadcast(index.withColumnRenamed("words", "template_words")), "word", "left")
    long_enough = F.size("own") >= F.col("need")
    reachable = F.least(F.col("size") - F.col("at"), F.size("own") - F.col("place")) >= F.col("need")
    shared = F.array_intersect("own", "template_words")
    once = F.get(shared, F.lit(0)) == F.col("word")  # each pair at its first shared word
    candidate = F.col("template").isNotNull() & long_enough & reachable & once & (F.size(shared) >= F.col("need"))
    out = pairs.select(*facts, F.when(candidate, matching_blocks()).alias("found")).groupBy("row").agg(*[F.first(c).alias(c) for c in facts[1:]], F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("blocks"))
    all_labels = F.array_sort(F.array_union("base_labels", F.col("blocks.label")))
    best = F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_distinct(all_labels), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks")


def oracle(templates: list[Template], threshold: float = 0.8) -> str:
    """DuckDB SQL for scan_licenses, without the blocks: every window that starts with a template's word is tried."""
    import re

    values = []
    for i, (label, text, *more) in enumerate(templates):
        every = re.findall(LICENSE_WORD, text.lower())
        words = sorted(set(every))
        listed = [", ".join(f"'{w}'" for w in ws) for ws in (words, *[m.split() for m in more or ("", "")])]
        values.append(f"({i}, '{label}', [{listed[0]}]::VARCHAR[], {max(1, math.ceil(threshold * len(words) - 1e-9))}, {len(every)}, [{listed[1]}]::VARCHAR[], [{listed[2]}]::VARCHAR[])")
    starts = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_transform(list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {test}), lambda i: {{'i': i, 'label': '{label}'}})")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH t(template, label, words, need, length, must, never) AS (VALUES {", ".join(values)}),
    b AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{LICENSE_WORD}') AS w FROM documents),
    p AS (SELECT r, doc_id, len(w) AS n_words, list_concat({", ".join(starts)}) AS found FROM b),
    k AS (SELECT r, label, len(words) AS size, need, list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i])), lambda i:
        CASE WHEN list_has_all(w[i:i + length - 1], must) AND NOT list_has_any(w[i:i + length - 1], never) THEN len(list_intersect(w[i:i + length - 1], words)) ELSE 0 END)) AS shared
      FROM b CROSS JOIN t WHERE len(list_intersect(w, words)) >= need),
    m AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS best FROM k WHERE shared >= need GROUP BY r)
    SELECT doc_id, n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.i)) AS first_word,
      list_max(list_transform(found, lambda x: x.i)) AS last_word,
      array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(list_transform(found, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
      CASE WHEN len(found) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
    FROM p LEFT JOIN m USING (r)"""
