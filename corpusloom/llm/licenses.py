"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of n words is sought in windows of 2n words that start every n words: wherever it stands, some window holds
it whole. Windows and templates are sets of `WIDTH`-word shingles. Each of `HASHES` minimum hashes is a band of its
own. A template of s shingles that a window holds has a similarity of at least s / (2n - 2) with it, 0.25 for the
shortest notices and towards 0.5 for long ones, so they meet with probability 1 - 0.75^32 = 0.9999 or more; at
`CONTAINED` percent of a ten-word template, 0.34, with 0.999998. Every pair that meets is checked on its shingles.

Documents are read once. Before windows are cut, one lossless test: a template cannot be contained unless one of any
floor(0.2 s) + 1 of its s shingles is there (pigeonhole), so a text without the longest word of each of these shingles is
done. It leaves out no match and keeps ordinary prose from being hashed. Long texts are worked on in segments of
`SEGMENT` words, whose shingles are hashed once; only windows that hold a shingle of a template of their size are
kept, as no other can contain one. They are written as a table with their own words; equal windows of the corpus are
sketched and verified once, so texts made of license lines cost in proportion to their length.

Words are runs of letters and digits, in lower case. Defined results: null and empty texts have no match. Matching
windows of one license are one row, with the best containment and the first word of the first such window.
Rows that share a doc_id are one document, and so are those whose doc_id is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compute import once
from ..session import cut
from .tables import read

WIDTH = 3
CONTAINED = 80
HASHES = 32
SEGMENT = 4_096
SEED = 131

# Fixed texts: public license notices by their identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL": "This work is licensed under the GNU General Public License, version",
    "GPL notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Warranty disclaimer": "the software is provided as is, without warranty of any kind, express or implied",
    "All rights reserved": "All rights reserved",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i:i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))]


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which a matching text has at least one."""
    found = set()
    for text in templates.values():
        own = sorted(set(grams(template_words(text))))
        need = len(own) * (100 - CONTAINED) // 100 + 1
        longest = sorted((max(g.split(" "), key=lambda w: (len(w), w)) for g in own), key=lambda w: (-len(w), w))
        found |= set(longest[:need])
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def keyed(words: Column) -> Column:
    """A hash of the `WIDTH`-word shingle that starts at each word; fewer words are one shingle."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WIDTH - 1)))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WIDTH)]))


def minima(keys: Column) -> Column:
    """The least hash of the keys in each band."""
    def band(k: int) -> Column:
        return F.array_min(F.transform(keys, lambda h: F.xxhash64(h, F.lit(SEED + k))))

    return F.array(*map(band, range(HASHES)))


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, windows, first_word) of every license that a document holds."""
    templates = TEMPLATES if templates is None else templates
    spark = documents.sparkSession
    held = [(name, template_words(text)) for name, text in sorted(templates.items())]
    if not held or min(len(w) for _, w in held) < WIDTH:
        raise ValueError(f"templates have at least {WIDTH} words")
    sizes = sorted({len(w) for _, w in held})
    lowered = once(documents.select("doc_id", "text"), lower=F.lower(F.col("text"))).drop("text")
    found = lowered.where(F.greatest(*[F.contains("lower", F.lit(w)).cast("int") for w in anchors(templates)], F.lit(0), F.lit(0)) == 1)
    words = F.filter(F.split("lower", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = once(found, words=words).drop("lower").where(F.size("words") > 0)
    segments = docs.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(SEGMENT))))
    segments = once(segments, part=F.slice("words", F.col("at") + 1, SEGMENT + 2 * sizes[-1]), left=F.size("words") - F.col("at")).drop("words")
    table = spark.createDataFrame([(len(w), name, w, sorted(set(grams(w)))) for name, w in held], "t_size int, license string, t_words array<string>, own array<string>")
    table = table.withColumn("t_keys", keyed(F.col("t_words"))).withColumn("t_least", minima(F.col("t_keys"))).drop("t_words")
    told = table.select("t_size", "t_keys", "t_least").collect()  # templates x (shingles + HASHES) numbers, a parameter's size
    known = F.array(*map(F.lit, sorted({v for r in told for v in r["t_least"]})))
    of_size = [F.array(*map(F.lit, sorted({v for r in told if r["t_size"] == n for v in r["t_keys"]}))) for n in sizes]
    segments = once(segments, keys=keyed(F.col("part")))
    # a window without any shingle of a template of its size holds no such template
    segments = once(segments, present=F.array(*[F.array_intersect("keys", own) for own in of_size])).where(F.exists("present", lambda p: F.size(p) > 0))

    def starts(k: int, n: int) -> Column:
        """The windows of 2n words that begin in the segment and hold a hit, with their words."""
        last = F.least(F.lit(SEGMENT), F.col("left")) - 1
        present = F.get("present", F.lit(k))
        hits = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.array_contains(present, F.get("keys", i)))
        holding = F.flatten(F.transform(hits, lambda i: F.transform(F.array(F.lit(0), F.lit(n)), lambda back: (
            F.floor((F.col("at") + i) / n) * n - F.col("at") - back).cast("int"))))
        begin = F.filter(F.array_distinct(holding), lambda s: (s >= 0) & (s <= last))
        windows = F.transform(begin, lambda s: F.struct(F.lit(n).alias("size"), (F.col("at") + s).alias("word"), F.slice("part", s + 1, 2 * n).alias("words")))
        return F.when(F.size(present) > 0, windows).otherwise(F.array().cast("array<struct<size:int,word:int,words:array<string>>>"))

    # windows carry their own words and no more; equal ones of the whole corpus are sketched and verified once
    windows = segments.select("doc_id", F.explode(F.concat(*[starts(k, n) for k, n in enumerate(sizes)])).alias("w")).select("doc_id", "w.*")
    windows = cut(windows)
    different = once(windows.select("size", "words").distinct(), least=minima(keyed(F.col("words"))))
    near = different.where(F.arrays_overlap("least", known))  # some template has one of the minima
    keys = table.select("t_size", "license", "own", "t_least", F.posexplode("t_least").alias("t_band", "t_value"))
    met = (near.select("*", F.posexplode("least").alias("band", "value"))
           .join(F.broadcast(keys), (F.col("size") == F.col("t_size")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value"))))
    # a window and a template that meet in several bands are verified in the first of them
    met = met.where(F.array_position(F.zip_with("least", "t_least", lambda a, b: a == b), True) == F.col("band") + 1)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WIDTH - 1))), lambda i: F.array_join(F.slice("words", i, WIDTH), " "))
    share = F.size(F.array_intersect(shingles, "own")) / F.size("own")
    verified = once(met.select("size", "words", "license", "own"), share=share).drop("own").where(F.col("share") * 100 >= CONTAINED)
    pairs = windows.join(verified, ["size", "words"])
    # rows that share a doc_id are one document: its windows of one place are one
    once_each = pairs.groupBy("doc_id", "license", "word").agg(F.max("share").alias("share"))
    return once_each.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("windows"), F.min("word").cast("long").alias("first_word"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
