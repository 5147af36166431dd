"""License scan: MinHash bands over overlapping windows, then exact containment.

DataFrame functions only. A text is cut into words (runs of ASCII letters and digits
and of characters beyond ASCII, A-Z in lower case). For templates of m words there
are windows of m + ceil(m / 2) words, one every ceil(m / 2), so that every run of m
words lies whole in one. A window's shingles of ``width`` words are hashed into
``bands`` MinHash bands; a band that equals a template's retrieves the template, and the
match stands if the window holds at least ``share`` of the template's shingles.

Band settings: a window that holds a share of at least 0.8 has a Jaccard similarity of
at least 1/3 with the template (the least is that of a template of three words, for the
longer ones it is about 0.45), so with 48 bands of one row a match is missed with a
probability of at most (2/3) ** 48, under 1e-8 (``miss_probability``).

Before that, windows and texts without any pivot word are left out, which loses
nothing: a template's pivots are words without which less than ``share`` of its
shingles remain, so that a match must hold one.

Scale: everything up to the last step is a projection of the scan, with the templates
(a list that does not depend on the data) as literals and as a small local table. Only
matches are shuffled, combined before by document and license.

Defined cases: null and empty texts match nothing; repeated rows of one doc_id give
one result; rows with a null id count as one document; texts shorter than a template
can match it if they hold enough of it; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices as they stand in licensed texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def shingles(words: list[str], width: int) -> list[str]:
    return list(dict.fromkeys(" ".join(words[k : k + width]) for k in range(len(words) - width + 1)))


# Words too common to be looked for first.
COMMON = frozenset("the of and to in a is that for it with as was on are this under without by from not or be at you may any all can an mit free person general".split())


def pivots(found: list[str], share: float) -> list[str]:
    """Words without which under ``share`` of the shingles remain: the longest first, as long words are rare."""
    words = sorted({w for s in found for w in s.split()}, key=lambda w: (w in COMMON, -len(w), w))
    chosen: list[str] = []
    left = found
    for word in words:
        if len(left) < share * len(found):
            break
        rest = [s for s in left if word not in s.split()]
        if len(rest) < len(left):
            chosen.append(word)
            left = rest
    return chosen


def miss_probability(bands: int, rows: int, jaccard: float) -> float:
    return (1 - jaccard**rows) ** bands


def _seeded(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def _windows(known: set[str], m: int) -> Column:
    """The windows of ``words`` for templates of ``m`` words that hold one of the words ``known``."""
    stride = math.ceil(m / 2)
    size = m + stride
    near = F.array(*map(F.lit, sorted(known)))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(near, w), i).otherwise(-1)), lambda i: i >= 0)
    around = F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / stride).cast("int")), F.floor(p / stride).cast("int")))
    return F.transform(F.array_distinct(F.flatten(around)), lambda k: F.struct(F.lit(m).alias("m"), (k * stride).alias("start"), F.lit(size).alias("n")))


def _bands(found: Column, bands: int, rows: int) -> Column:
    """A struct of number and key for each band, over the shingles."""
    hashes = F.transform(found, lambda s: F.xxhash64(s))
    least = [F.array_min(F.transform(hashes, _seeded(k))) for k in range(bands * rows)]
    return F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(*least[b * rows : (b + 1) * rows]).alias("key")) for b in range(bands)))


def _shingled(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, width: int = 3, share: float = 0.8, bands: int = 48, rows: int = 1) -> DataFrame:
    """(id, license, containment, first_word, n_windows) for each document and license found.

    ``containment`` is the best window's, ``first_word`` the first such window's first word
    (from 0), ``n_windows`` the number of windows that match.
    """
    spark = docs.sparkSession
    cut = {name: template_words(text) for name, text in (templates or TEMPLATES).items()}
    if short := [name for name, words in cut.items() if len(words) < width]:
        raise ValueError(f"templates of under {width} words: {short}")
    by_length: dict[int, set[str]] = {}
    for words in cut.values():
        by_length.setdefault(len(words), set()).update(pivots(shingles(words, width), share))
    every = sorted(set().union(*by_length.values()))

    low = F.lower(F.col(text_col))
    has = F.lit(False)
    for word in every:
        has = has | F.contains(low, F.lit(word))
    # as a part of a word first, which is quick, and then as a word
    whole = low.rlike(rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:{'|'.join(every)})(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])")
    kept = docs.where(has & whole).select(F.col(id_col).alias("id"), F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    parts = [_windows(known, m) for m, known in sorted(by_length.items())]
    spots = kept.select("id", "words", F.explode(F.concat(*parts)).alias("w"))
    windows = spots.select("id", "w.m", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.n")).alias("part")).where(F.size("part") >= width)
    windows = windows.select("id", "m", "start", _shingled(F.col("part"), width).alias("found"))

    texts = lambda found: F.array(*map(F.lit, found))
    listed = [F.struct(F.lit(name).alias("license"), F.lit(len(words)).alias("m"), texts(shingles(words, width)).alias("wanted")) for name, words in cut.items()]
    known = spark.range(1).select(F.inline(F.array(*listed)))
    banded = known.select("license", "m", "wanted", F.inline(_bands(F.col("wanted"), bands, rows)))
    # the bands of all templates of a length, as a local table of fixed size
    keys = windows.withColumn("b", F.explode(_bands(F.col("found"), bands, rows))).select("id", "m", "start", "found", "b.band", "b.key")
    hits = keys.join(F.broadcast(banded), ["m", "band", "key"])
    held = F.size(F.array_intersect("found", "wanted")) / F.size("wanted")
    matches = hits.withColumn("containment", held).where(F.col("containment") >= share)
    by_window = matches.groupBy("id", "license", "start").agg(F.max("containment").alias("containment"))
    return by_window.groupBy(F.col("id").alias(id_col), "license").agg(
        F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("n_windows")
    )


def oracle(width: int = 3, share: float = 0.8) -> str:
    """DuckDB SQL that gives the same rows by counting every template shingle in every window."""
    rows = []
    for name, text in TEMPLATES.items():
        words = template_words(text)
        found = shingles(words, width)
        rows += [f"('{name}', {len(words)}, {len(found)}, '{s}')" for s in found]
    return rf"""
with templates(license, m, total, shingle) as (values {", ".join(rows)}),
lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as x from documents
),
places as (
  select doc_id, k - 1 as place, array_to_string(x[k:k + {width - 1}], ' ') as shingle
  from (select doc_id, x, unnest(range(1, len(x) - {width} + 2)) as k from lists where len(x) >= {width})
),
hits as (
  select doc_id, license, total, shingle, place, m, ceil(m / 2.0)::bigint as stride from places join templates using (shingle)
),
windows as (
  select doc_id, license, total, shingle, stride * unnest(range(greatest(0, ceil((place + {width} - m - stride) / stride::double)::bigint), place // stride + 1)) as start
  from hits
),
held as (
  select doc_id, license, start, count(distinct shingle) / total::double as containment from windows group by doc_id, license, start, total
)
select doc_id, license, max(containment) as containment, min(start)::bigint as first_word, count(*) as n_windows
from held where containment >= {share} group by doc_id, license
"""
