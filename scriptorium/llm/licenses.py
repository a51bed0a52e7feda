"""License scans: MinHash bands over overlapping text windows, then exact containment.

Templates and texts become lower-case words of letters, digits, dots and plus
signs. Texts are cut into overlapping windows of about a template's length, one
length for each class of templates. A window whose least shingle hash agrees with
a template's under one of BANDS hash functions is compared with it: share of the
template's shingles that the window contains. A window that lies on a template's
copy shares at least 0.35 of their union, so it is missed with probability
0.65 ** 24 = 3e-5 at most.

A first test leaves out texts that cannot match: each template has a few anchor
words that so many of its shingles hold that a window without any of them misses
more shingles than the threshold allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import text_of

SHINGLE, CONTAINED, BANDS = 3, 0.8, 24

# Notices by which texts name their licence.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_TOKEN = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"


def words_of(text: str) -> list[str]:
    """The words of a template, as the scan sees those of a text."""
    import re

    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def anchors(words: list[str], contained: float = CONTAINED) -> set[str]:
    """Words that more than 1 - contained of the distinct shingles hold, rarest-looking (longest) first."""
    shingles = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    needed = math.floor((1 - contained) * len(shingles) + 1e-9) + 1
    out: set[str] = set()
    for word in sorted(set(words), key=lambda x: (x not in {"license", "licensed", "licence", "public", "copyright", "permission", "redistribution"}, -len(x), x)):
        out.add(word)
        if sum(any(w in out for w in s) for s in shingles) >= needed:
            return out
    return out


def _shingles(words: Column) -> Column:
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, SHINGLE))))
    return F.array_distinct(F.when(n > 0, many).otherwise(F.array().cast("array<bigint>")))


def _least(shingles: Column) -> Column:
    """The bands: for each hash function its number and the least hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))).alias("hash")))


def _length_class(n: int) -> int:
    """The least of 5, 7, 10, 14, 20, 28, … that isn't below n."""
    size = 5.0
    while round(size) < n:
        size *= math.sqrt(2)
    return round(size)


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row a match of (row, text): row, license, start (in words), n_words of the window, containment.

    Overlapping windows that match one template are one match, the best of them;
    of overlapping matches of several templates the best stays. Null, empty and unmatched texts give no rows.
    """
    spark = docs.sparkSession
    rows = [(name, _length_class(len(words_of(text))), words_of(text)) for name, text in templates.items()]
    known = spark.createDataFrame(rows, "license string, size int, words array<string>").withColumn("shingles", _shingles(F.col("words")))
    keys = F.broadcast(known.select("license", "size", F.col("shingles").alias("wanted"), F.explode(_least(F.col("shingles"))).alias("k")).select("license", "size", "wanted", "k.*"))  # BANDS rows a template
    gate = "|".join(sorted({w.replace(".", r"\.").replace("+", r"\+") for _, _, words in rows for w in anchors(words)}))
    lower = F.lower(text_of())
    some = docs.select("row", lower.alias("t")).where(F.col("t").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{gate})(?![\p{{L}}\p{{N}}])"))
    some = some.select("row", F.regexp_extract_all("t", F.lit(_TOKEN), 0).alias("words"))
    sizes = F.array(*(F.lit(s) for s in sorted({s for _, s, _ in rows})))
    # a window is a quarter longer than its class and windows start a quarter of it apart
    step = lambda s: F.greatest(F.floor(s / 4), F.lit(1)).cast("int")
    some = some.select("row", "words", F.explode(sizes).alias("size"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.col("size"), F.lit(0)) + step(F.col("size")) - 1, step(F.col("size")))
    windows = some.select("row", "size", F.posexplode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("words", i + 1, F.col("size") + step(F.col("size"))).alias("w")))).alias("nr", "x"))
    marks = F.array(*(F.lit(w) for w in sorted({w for _, _, words in rows for w in anchors(words)})))
    windows = windows.where(F.arrays_overlap("x.w", marks))  # the first test again, for each window
    windows = windows.select("row", "size", "nr", "x.start", F.size("x.w").alias("n_words"), _shingles(F.col("x.w")).alias("shingles")).where(F.size("shingles") > 0)
    banded = windows.select("*", F.explode(_least(F.col("shingles"))).alias("k")).select("row", "size", "nr", "start", "n_words", "shingles", "k.*")
    inside = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    met = banded.join(keys, ["size", "band", "hash"]).withColumn("containment", inside).where(F.col("containment") >= CONTAINED - 1e-9)
    met = met.groupBy("row", "license", "size", "nr").agg(F.first("start").alias("start"), F.first("n_words").alias("n_words"), F.first("containment").alias("containment"), F.first(F.size("wanted")).alias("n"))
    # neighbouring windows of one text and template are one match
    own = W.partitionBy("row", "license").orderBy("nr")
    runs = met.withColumn("__gap", F.coalesce((F.col("nr") - F.lag("nr").over(own) > 4).cast("int"), F.lit(1)))
    runs = runs.withColumn("__run", F.sum("__gap").over(own.rowsBetween(W.unboundedPreceding, 0)))
    best = F.min(F.struct((-F.col("containment")).alias("c"), "start", "n_words", "n"))
    matches = runs.groupBy("row", "license", "__run").agg(best.alias("b")).select("row", F.struct("license", "b.start", "b.n_words", (-F.col("b.c")).alias("containment"), "b.n").alias("m"))
    # where matches overlap, that of the higher containment, then of the longer template, stays: a version's or a variant's notice is not its sister's
    together = matches.groupBy("row").agg(F.sort_array(F.collect_list("m")).alias("all"))
    over = lambda x, y: (x["start"] < y["start"] + y["n_words"]) & (y["start"] < x["start"] + x["n_words"])
    better = lambda x, y: (y["containment"] > x["containment"]) | ((y["containment"] == x["containment"]) & (y["n"] > x["n"]))
    stay = F.filter("all", lambda x: ~F.exists("all", lambda y: over(x, y) & better(x, y)))
    return together.select("row", F.explode(stay).alias("m")).select("row", "m.license", "m.start", "m.n_words", "m.containment")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches and licenses (sorted names, comma-joined) of every row of docs.

    Rows without a match have 0 and an empty string. Rows that share a doc_id are told apart by their text.
    """
    row = F.struct(F.col("doc_id"), F.xxhash64(text_of()).alias("h"))
    # equal rows would pool their matches: a row's own are the distinct (license, start)
    found = license_matches(docs.select(row.alias("row"), "text")).select("row", "license", "start").distinct()
    found = found.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("names"))
    found = found.select(F.col("row.h").alias("h"), F.col("row.doc_id").alias("__id"), "n", "names")
    small = docs.select("doc_id", F.xxhash64(text_of()).alias("__h"))
    joined = small.join(found, (F.col("__h") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("names", F.lit("")).alias("licenses"))
