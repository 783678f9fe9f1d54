"""Licence scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only, inside each row: no shuffle.  A band's key is one of the window's own shingles, so only texts that hold
some shingle of a template get windows.  A template is looked for with the largest window of
``WINDOWS`` that it fills; its own windows start at every word, those of a text at every ``stride``-th, so some window of
a text lies ``stride / 2`` words at most beside a window of the template and shares three quarters of its shingles or
more.  A band is one minimum, and six bands miss such a window with a chance of 0.25 ** 6 < 3e-4; the smallest window is one
shingle, which one band never misses.  A template is reported where a text holds ``CONTAINED`` of its distinct shingles, one of
fewer than ``WHOLE`` where it holds all: a notice differs from that of another version in one word.

Words are runs of letters and digits, in lower case.  Defined results: a null or empty text, or one of fewer words
than a shingle, matches nothing; repeated rows are reported each; a null doc_id is kept; an empty table gives no row;
other columns are ignored; templates must have five words or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WIDTH = 5
CONTAINED = 0.75
WHOLE = 20
#: (words, stride, bands)
WINDOWS = ((5, 1, 1), (12, 2, 6), (40, 8, 6))
_SALTS = (0x6A09E667F3BCC908, 0x3B67AE8584CAA73B, -0x3C6EF372FE94F82B, -0x5A0EB7D2C1F43A1D, 0x510E527FADE682D1, -0x64CA7C98D2E1B5F7)

# Wording of notices and of the texts that licences ask to be repeated.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column) -> Column:
    """The shingles as text, in order."""
    n = F.size(words) - (WIDTH - 1)
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, WIDTH), " "))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    n = F.size(words) - (WIDTH - 1)
    at = lambda i, k: F.get(words, i + k)
    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(at(i, k) for k in range(WIDTH))))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<bigint>"))


def _band_keys(hashes: Column, salted: list[Column], words: int, stride: int, bands: int) -> Column:
    """Window minima of every band; a text shorter than the window is one window."""
    width = words - WIDTH + 1
    if width == 1:
        return hashes
    n = F.size(hashes)
    last = F.greatest(n - width, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    # A minimum is found back by its salt, so bands can't be confused.
    least = lambda c: F.transform(starts, lambda i: F.array_min(F.slice(c, i + 1, width)))
    mins = [least(c) for c in salted[:bands]]
    return F.when(n > 0, F.concat(*mins)).otherwise(F.array().cast("array<bigint>"))


def _salted(hashes: Column) -> list[Column]:
    salt = lambda s: F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(s)))
    return [salt(s) for s in _SALTS]


def template_table(spark, templates: dict[str, str] = TEMPLATES) -> list[dict]:
    """Per template: its name, distinct shingles, and band keys with a stride of one.  Its size depends on the templates alone."""
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "license string, text string")
    rows = rows.withColumn("words", _words(F.col("text"))).withColumn("hashes", _hashes(F.col("words")))
    if short := [r["license"] for r in rows.where(F.size("words") < WIDTH).collect()]:
        raise ValueError(f"templates with fewer than {WIDTH} words: {short}")
    keys = F.array().cast("array<bigint>")
    for size, _, bands in WINDOWS:
        keys = F.when(F.size("words") >= size, _band_keys(F.col("hashes"), _salted(F.col("hashes")), size, 1, bands)).otherwise(keys)
    made = {"shingles": _shingles(F.col("words")), "hashes": F.col("hashes"), "keys": keys}
    return [r.asDict() for r in rows.select("license", *(F.array_distinct(c).alias(n) for n, c in made.items())).collect()]


def _holds_any(text: Column, hashes: Column) -> Column:
    """Whether the text holds a shingle of these hashes; as one expression, in which its words are taken once."""
    return F.exists(F.array(_words(text)), lambda words: F.exists(F.array(_hashes(words)), lambda own: F.arrays_overlap(own, hashes)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word (place of the first shared shingle) of every match."""
    table = template_table(docs.sparkSession, templates)
    array = lambda xs: F.array(*map(F.lit, xs))
    near = docs.where(_holds_any(F.col("text"), array(sorted({h for t in table for h in t["hashes"]}))))
    words = near.select("doc_id", _words(F.col("text")).alias("words"))
    hashed = words.withColumn("hashes", _hashes(F.col("words")))
    names = [f"m{k}" for k in range(len(_SALTS))]
    salted = hashed.select("*", *(c.alias(n) for c, n in zip(_salted(F.col("hashes")), names)))
    keys = F.concat(*(_band_keys(F.col("hashes"), [F.col(n) for n in names], *w) for w in WINDOWS))
    wanted = sorted({k for t in table for k in t["keys"]})
    hits = salted.select("doc_id", "words", F.array_intersect(keys, array(wanted)).alias("hits"))
    # One row for each template that shares a band; made by a generator, so keys are computed once a row.
    of = F.concat(*(F.when(F.arrays_overlap("hits", array(t["keys"])), array([k])).otherwise(F.array().cast("array<int>")) for k, t in enumerate(table)))
    found = hits.select("doc_id", "words", F.explode(of).alias("k"))
    held = F.element_at(F.array(*(array(t["shingles"]) for t in table)), F.col("k") + 1)
    checked = found.select("doc_id", "k", _shingles(F.col("words")).alias("own"), held.alias("template"))
    shared = checked.select("doc_id", "k", "own", "template", F.array_intersect("template", "own").alias("shared"))
    least = F.when(F.size("template") < WHOLE, 1.0).otherwise(CONTAINED) * F.size("template")
    return shared.where(F.size("shared") >= least).select(
        "doc_id", F.element_at(array([t["license"] for t in table]), F.col("k") + 1).alias("license"),
        (F.size("shared") / F.size("template")).alias("containment"),
        F.aggregate("shared", F.lit(None).cast("long"), lambda a, s: F.least(a, F.array_position("own", s)), lambda a: a - 1).alias("first_word"),
    )
