"""License scan with MinHash bands over overlapping windows, in DataFrame functions only.

Templates fall into classes of similar length, and each class has windows twice as long, laid at steps of half their
length, so that every passage as long as a template lies whole in some window. Windows that hold a shingle of a template
get MinHash values; each band is a lookup into the templates. The number of bands is set so that a template whose share
``CONTAINMENT`` is in the window is retrieved with probability ``CERTAINTY`` at least; retrieved pairs are then verified by
the exact share of the template's shingles in the window. A window without any shingle of any template can not pass that
test, so leaving it out before hashing loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 3
CONTAINMENT = 0.8
CERTAINTY = 0.9999

#: Notices that license a text (fixed values).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("LicenseRef-reserved", "All rights reserved."),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, template string")


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, words: int) -> Column:
    """Hashes of the runs of ``words`` lower-case words, in order; of the whole text if it has fewer, none if it has none."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return _once(split, runs)


def bands_for(template: int, window: int, containment: float, certainty: float) -> int:
    """Bands of one MinHash each that retrieve a template of ``template`` shingles from a window of ``window``."""
    shared = max(1, math.ceil(containment * template))
    alike = shared / (window + template - shared)
    return math.ceil(math.log(1 - certainty) / math.log(1 - alike)) if alike < 1 else 1


def _keys(hashes: Column, bands: int) -> Column:
    values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))).alias("low")))
    return F.explode(values)


def scan(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    containment: float = CONTAINMENT,
    certainty: float = CERTAINTY,
) -> DataFrame:
    """``doc_id, license, containment, word_at``: one row for each document and license found, with the greatest share of
    one of its templates in a window and the first word of the earliest such window.

    ``templates`` (``license, template``) is a reference list that fits the driver; null or wordless templates find
    nothing. Null, empty and wordless texts hold no license. Rows with the same id are one document; a null id is an
    id like any other. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = notices(spark) if templates is None else templates
    known = templates.select("license", F.array_distinct(shingles(F.col("template"), words)).alias("t")).where(F.size("t") > 0).collect()
    empty = "doc_id long, license string, containment double, word_at long"
    if not known:
        return spark.createDataFrame([], empty)
    wanted = sorted({h for r in known for h in r["t"]})
    # Window lengths in shingles: twice the least power of two that holds the template.
    sizes = sorted({2 << math.ceil(math.log2(len(r["t"]))) for r in known})
    bands = {s: max(bands_for(len(r["t"]), s, containment, certainty) for r in known if 2 << math.ceil(math.log2(len(r["t"]))) == s) for s in sizes}
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), shingles(F.col(f"`{text_col}`"), words).alias("h"))

    def windows(h: Column) -> Column:
        hits = F.filter(F.transform(h, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())

        def of(size: int, places: Column) -> Column:
            step = size // 2
            index = F.flatten(F.transform(places, lambda p: F.array(F.floor(p / step).cast("int"), F.floor(p / step).cast("int") - 1)))
            index = F.filter(F.array_distinct(index), lambda i: i >= 0)
            return F.transform(index, lambda i: F.struct(F.lit(size).alias("size"), (i * step).alias("at"), F.array_distinct(F.slice(h, i * step + 1, size)).alias("w")))

        return _once(hits, lambda places: F.when(F.size(places) > 0, F.flatten(F.array(*[of(s, places) for s in sizes]))))

    # Only windows round a hit leave the documents.
    spots = found.select("doc_id", F.explode(_once(F.col("h"), windows)).alias("x")).select("doc_id", "x.size", "x.at", "x.w")
    table = spark.createDataFrame([(i, r["license"], 2 << math.ceil(math.log2(len(r["t"]))), r["t"]) for i, r in enumerate(known)], "no int, license string, size int, t array<long>")
    parts = []
    for size in sizes:
        here = spots.where(F.col("size") == size).select("doc_id", "at", "w", _keys(F.col("w"), bands[size]).alias("k")).select("doc_id", "at", "w", "k.band", "k.low")
        there = table.where(F.col("size") == size).select("no", _keys(F.col("t"), bands[size]).alias("k")).select("no", "k.band", "k.low")
        parts.append(here.join(F.broadcast(there), ["band", "low"]).select("doc_id", "at", "w", "no").distinct())
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    share = F.size(F.array_intersect("t", "w")) / F.size("t")
    checked = met.join(F.broadcast(table.select("no", "license", "t")), "no").select("doc_id", "license", "at", share.alias("containment"))
    return (
        checked.where(F.col("containment") >= containment)
        .groupBy("doc_id", "license")
        .agg(F.max("containment").alias("containment"), F.min(F.col("at").cast("long")).alias("word_at"))
    )
