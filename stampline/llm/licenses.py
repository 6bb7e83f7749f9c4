"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame functions only.

Templates are dealt to window sizes: a template of L words is looked for in windows of the least size W (a power of two, 16 at least)
with L <= W / 2, which start every W / 2 words, so each occurrence lies whole in a window.

A window meets a template in a band if their least hashes are equal, so only if the window holds the shingle that is the template's least
there, and nothing less. The scan therefore looks for the bands' least shingles, and hashes the windows that hold one: the collisions
are those of hashing every window of every text, without hashing the windows that can't collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, table
from .scan import SEPARATORS, ascii_lower, find, grams

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of one row. A window that holds all of a template of one shingle and W - 4 = 12 shingles has a similarity of 1 / 12
#: or more and misses all bands with a probability of (11 / 12) ** 96 = 0.0002; larger templates fill more of their window.
BANDS = 96
#: A template of fewer words than a shingle is one shingle of all of them, among 16 of its length at most in its window; with so many bands it
#: misses all with a probability of (15 / 16) ** 192 = 0.000004 at most.
SHORT_BANDS = 192
LEAST_WINDOW = 16

# License names and the lines that state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession, given: tuple = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(given)], "template int, license string, text string")


def shingles(words: Column, size: Column | int = SHINGLE) -> Column:
    """Distinct shingles of ``size`` words of an array of lower-case words; fewer words than a shingle are one."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.size(words) - (size - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")))


def minhash(shingles_: Column, size: Column | int = SHINGLE) -> Column:
    """The least hash of the shingles, of ``size`` words, under each of BANDS (SHORT_BANDS for short ones) hash functions."""
    size = F.lit(size) if isinstance(size, int) else size
    hashes = F.transform(shingles_, lambda s: F.xxhash64(s))
    last = F.when(size < SHINGLE, SHORT_BANDS - 1).otherwise(BANDS - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def banded(shingles_: Column, size: Column | int = SHINGLE) -> Column:
    """Of each band the least hash and a shingle that has it."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.when(size < SHINGLE, SHORT_BANDS - 1).otherwise(BANDS - 1)
    pair = lambda b: lambda s: F.struct(F.xxhash64(F.xxhash64(s), b).alias("least"), s.alias("shingle"))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.array_min(F.transform(shingles_, pair(b))))


def _lower_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def scan(docs: DataFrame, known: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, n_words, n_windows, licenses (sorted names): one row per row of ``docs``.

    n_windows counts the windows in which a template was verified. Containment is the share of a template's distinct shingles of five
    words that are in the window. Null, empty and wordless texts have none. Templates of fewer than five words are one
    shingle, which is looked for among the window's shingles of as many words; templates without words match nothing; null names are not listed. Null doc_id is a key like any other,
    repeated rows give repeated results. Other columns of either table are not read; empty tables give no rows or no
    licenses. The templates and their bands are broadcast only while they fit by rows and bytes; larger ones are joined by
    shuffling the candidate windows. A hit carries the words around it, not its whole text.
    """
    known = templates(docs.sparkSession) if known is None else known
    known = known.select(F.monotonically_increasing_id().alias("t"), F.col("license").cast("string").alias("license"), _lower_words(F.col("text")).alias("tw"))
    known = table(known, "templates").filter(F.size("tw") > 0)  # written, so that the numbers stay
    window = F.greatest(F.lit(LEAST_WINDOW), F.pow(F.lit(2), F.ceil(F.log2(F.size("tw") * 2.0))).cast("int"))
    known = known.select("t", "license", window.alias("w"), shingles(F.col("tw")).alias("ts"), F.least(F.size("tw"), F.lit(SHINGLE)).alias("s"))
    index = known.select("t", "w", "s", F.posexplode(banded(F.col("ts"), F.col("s"))).alias("band", "x")).select("t", "w", "s", "band", "x.*")
    most = known.agg(F.coalesce(F.max("w"), F.lit(0))).first()[0]
    # a shingle is its own only window of its size; no longer text comes of it
    wanted = grams(index.select(F.col("w").alias("id"), F.col("shingle").alias("text")).distinct(), "id", "text", SHINGLE)
    keys = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    low = F.greatest(F.col("pos") - F.col("back") - most, F.lit(0)).alias("low")
    near = find(docs, keys, "text", wanted, [low, F.slice("ws", low + 1, F.lit(2 * most + SHINGLE)).alias("ws")])
    return _judge(near, known, index.drop("shingle"), containment)


def _judge(near: DataFrame, known: DataFrame, index: DataFrame, containment: float) -> DataFrame:
    """near: doc_id, text_hash, start, n (words of the shingle), low, ws (the words around it, from low on), ids (window sizes); one row per band's least shingle
    that occurs, and one per text."""
    w = F.col("w").cast("int")
    half = F.expr("cast(w as int) div 2")
    spots = near.select("doc_id", "text_hash", "start", "n", "low", "ws", F.explode_outer("ids").alias("w"))
    # the windows that hold the shingle whole: those that start at the multiples of half a window up to the shingle's start
    over = F.col("start") + F.col("n") - w
    first = F.greatest(F.floor(over / half) + F.when(over % half > 0, 1).otherwise(0), F.lit(0))
    at = F.when(F.col("n") > 0, F.sequence(first.cast("int"), F.floor(F.col("start") / half).cast("int")))
    spots = spots.select("doc_id", "text_hash", "start", "n", "low", "ws", "w", F.explode_outer(at).alias("at"))
    win = F.when(F.col("n") > 0, F.transform(F.slice("ws", F.greatest(F.col("at") * half - F.col("low") + 1, F.lit(1)), w), lambda x: ascii_lower(x)))
    spots = spots.select("doc_id", "text_hash", F.when(F.col("n") == 0, F.col("start")).alias("n_words"), "w", F.col("n").alias("s"), "at", win.alias("win"))
    counted = spots.groupBy("doc_id", "text_hash", "w", "s", "at").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"), F.first("win").alias("win"))
    hashed = counted.filter("win is not null").select("doc_id", "text_hash", w.alias("w"), "s", "at", shingles(F.col("win"), F.col("s")).alias("ws"))
    banded_ = hashed.select("*", F.posexplode(minhash(F.col("ws"), F.col("s"))).alias("band", "least"))
    met = banded_.join(F.broadcast(index) if fits(index, F.lit(40)) else index, ["w", "s", "band", "least"]).dropDuplicates(["doc_id", "text_hash", "w", "at", "t"])
    of = known.select("t", "license", "ts")
    size = F.coalesce(F.octet_length("license"), F.lit(0)) + F.octet_length(F.array_join("ts", " ")) + 32 * F.size("ts")
    good = met.select("doc_id", "text_hash", "w", "at", "t", "ws").join(F.broadcast(of) if fits(of, size) else of, "t")
    good = good.filter(F.size(F.array_intersect("ts", "ws")) >= F.lit(containment) * F.size("ts"))
    found = good.groupBy("doc_id", "text_hash").agg(F.count_distinct(F.struct("w", "at")).alias("n_windows"), F.array_sort(F.collect_set("license")).alias("licenses"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "n_windows", "licenses")
    base = counted.filter("n_words is not null").select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["_d"]) & (base["text_hash"] == found["_h"]), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
