"""License scans: MinHash bands over overlapping windows of text retrieve templates, exact shingle containment verifies them.

Only DataFrame functions are used. Texts are cut into words (runs of letters and digits, lower-cased) and five-word shingles. A template
of t shingles is looked for in windows of 2t shingles that start every t shingles, so a whole copy of it lies within one window. Such a
window and the template have a Jaccard similarity of at least 0.36 even where only 0.8 of the template is there, and BANDS bands of one
MinHash value each then miss it with a probability below 0.64 ** 32 = 6.3e-7.

With one value a band, a window can only meet a template in a band through the shingle that gives the template's value there. So the
MinHash values are computed for the windows around such shingles alone; no other window could be retrieved. A template is found if at
least `similarity` of its distinct shingles are in the window, compared as strings.

Nulls and odd rows: a null text counts as empty and holds no license. Texts and templates of fewer than five words are one shingle of
all their words; without words they match nothing. Rows with a null doc_id take part; rows with the same doc_id are one document, and
the result has one row for each document and license: the largest containment and the first place of a window with it. Templates
without id or text are left out; of several with one id the best counts. Empty tables give empty results. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_of, key_of, table, written

SHINGLE, SIMILARITY, BANDS, MOST_SHINGLES = 5, 0.8, 32, 20_000
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("lgpl-2.1", "This library is distributed under the GNU Lesser General Public License, version 2.1"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify and distribute this software for any purpose with or without fee"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it, and wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each_shingle(w: Column, make) -> Column:
    """make(first word's number) for each shingle of the words w; shorter texts have one, empty ones none."""
    last = F.greatest(F.size(w) - SHINGLE + 1, F.least(F.size(w), F.lit(1)))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), make)).otherwise(F.transform(F.slice(F.sequence(F.lit(1), F.lit(2)), 1, 0), make))


def shingle_hashes(w: Column) -> Column:
    return _each_shingle(w, lambda i: F.xxhash64(*(F.get(w, i - 1 + k) for k in range(SHINGLE))))


def shingles(w: Column) -> Column:
    return _each_shingle(w, lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))


def min_hash(s: Column, band: int) -> Column:
    return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(band))))


def band_values(s: Column) -> Column:
    return F.array(*(min_hash(s, j) for j in range(BANDS)))


def templates_of(templates: DataFrame) -> DataFrame:
    """license_id, shingles (distinct), t (their number), bands, and picks: hashes of the shingles that give the band values."""
    t = templates.where(F.col("license_id").isNotNull() & F.col("text").isNotNull()).select(F.col("license_id").cast("string").alias("license_id"), words(F.col("text").cast("string")).alias("w"))
    t = t.select("license_id", F.array_distinct(once(F.col("w"), shingles)).alias("shingles"), F.array_distinct(once(F.col("w"), shingle_hashes)).alias("hashes"))
    t = t.where(F.size("shingles") > 0).withColumn("t", F.size("shingles")).withColumn("bands", band_values(F.col("shingles")))
    both = F.arrays_zip("shingles", "hashes")
    pick = F.array(*(F.array_min(F.transform(both, lambda x, j=j: F.struct(F.xxhash64(x["shingles"], F.lit(j)).alias("v"), x["hashes"].alias("h"))))["h"] for j in range(BANDS)))
    return t.withColumn("picks", F.array_distinct(pick))


def license_scan(docs: DataFrame, templates: DataFrame, similarity: float = SIMILARITY, most_shingles: int = MOST_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment, first_word (number, from 0, of the first word of the first window with that containment)."""
    library = templates_of(templates)
    total, lengths = library.agg(F.sum("t"), F.collect_set("t")).first()
    texts = docs.select(key_of(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    small = (total or 0) <= most_shingles
    if small:  # the shingles looked for are constants of the scan
        picks = sorted({p for r in library.select("picks").collect() for p in r[0]})
        wanted = F.array(*(F.lit(int(p)) for p in picks)).cast("array<bigint>")
        hashed = once(words(F.col("body")), shingle_hashes)
        near = texts.where(F.arrays_overlap(hashed, wanted)).select("key", words(F.col("body")).alias("w"))
        at = once(F.col("w"), lambda w: once(shingle_hashes(w), lambda h: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(wanted, x), i)), lambda i: i.isNotNull())))
        near = near.select("key", "w", at.alias("at"))
    else:  # too many of them: found by a shuffled join
        numbered = written(texts.select(F.monotonically_increasing_id().alias("row"), "key", "body"), "texts")  # so that a text keeps its number
        every = numbered.select("row", F.posexplode(once(words(F.col("body")), shingle_hashes)).alias("i", "h"))
        found = every.join(library.select(F.explode("picks").alias("h")).distinct(), "h").groupBy("row").agg(F.collect_set("i").alias("at"))
        near = numbered.select("row", "key", words(F.col("body")).alias("w")).join(found, "row").select("key", "w", "at")
    spans = F.array(*(F.lit(int(t)) for t in sorted(lengths))).cast("array<int>")
    starts = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda i: F.flatten(F.transform(spans, lambda t: F.array(F.struct(t.alias("t"), F.floor(i / t).cast("int").alias("k")), F.struct(t.alias("t"), F.greatest(F.floor(i / t).cast("int") - 1, F.lit(0)).alias("k"))))))))
    windows = near.select("key", "w", F.explode(starts).alias("s")).select("key", F.col("s.t").alias("t"), (F.col("s.t") * F.col("s.k")).alias("first_word"), F.slice("w", F.col("s.t") * F.col("s.k") + 1, 2 * F.col("s.t") + SHINGLE - 1).alias("part"))
    windows = windows.select("key", "t", "first_word", F.array_distinct(once(F.col("part"), shingles)).alias("here"))
    probes = windows.select("key", "t", "first_word", "here", F.posexplode(band_values(F.col("here"))).alias("band", "value"))
    bands = library.select("license_id", "t", "shingles", F.posexplode("bands").alias("band", "value"))
    share = F.size(F.array_intersect("here", "shingles")) / F.col("t")
    met = probes.join(F.broadcast(bands) if small else bands, ["t", "band", "value"]).select("key", "license_id", "first_word", share.alias("containment")).where(F.col("containment") >= similarity)
    best = met.groupBy("key", "license_id").agg(F.min(F.struct((-F.col("containment")).alias("c"), "first_word")).alias("b"))
    return best.select(id_of("key").alias("doc_id"), "license_id", (-F.col("b.c")).alias("containment"), F.col("b.first_word").cast("long").alias("first_word"))


def op5_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of TEMPLATES in all of `documents`."""
    return license_scan(table(spark, sf_dir, "documents"), spark.createDataFrame(TEMPLATES, "license_id string, text string"))


OP5_SQL = r"""
WITH templates AS (
    SELECT row_number() OVER () AS n, license_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
    FROM (VALUES %s) AS v(license_id, text)
), template_shingles AS (
    SELECT DISTINCT n, license_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT n, license_id, w, unnest(range(1, len(w) - 3)) AS i FROM templates)
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY n) AS t FROM template_shingles
), doc_words AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), doc_shingles AS (
    SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)
), met AS (
    SELECT doc_id, n, license_id, t, s, unnest([i // t, greatest(i // t - 1, 0)]) AS k FROM doc_shingles JOIN sized USING (s)
), shares AS (
    SELECT doc_id, license_id, t * k AS first_word, count(DISTINCT s) / t AS containment FROM met GROUP BY doc_id, n, license_id, t, k
)
SELECT doc_id, license_id, max(containment) AS containment, CAST(arg_max(first_word, (containment, -first_word)) AS BIGINT) AS first_word
FROM shares WHERE containment >= 0.8 GROUP BY doc_id, license_id
""" % ", ".join("('{}', '{}')".format(*t) for t in TEMPLATES)  # noqa: UP032
