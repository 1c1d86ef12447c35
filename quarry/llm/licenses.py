"""License scans by MinHash over text windows (operator 9). DataFrame functions only.

Texts and templates are lower-cased and cut into words of letters and digits; shingles are five words (a shorter
template: all its words). A window holds as many shingles as the template's size class. Each of the `bands` bands of
one row keeps the smallest of a window's shingle hashes under its own permutation; a window retrieves a template if they
agree in some band. Windows have under three times a template's shingles and overlap so far that each run of its length
lies whole in one. So a window that holds the whole template shares over a third of its shingles with it and is retrieved
with a probability above 1 - (2/3)**32 = 0.999997; one that holds four fifths of it shares over a quarter, with a
probability above 1 - (3/4)**32 = 0.9999. Retrieved windows are verified by exact containment of the template's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scattered

# Published licence notices and the openings of licence texts.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
SHINGLE = 5
BANDS = 32


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles; none if there are fewer words."""
    n = F.size(w) - (k - 1)
    own = [lambda i, j=j: F.get(w, i + j) for j in range(k)]
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[f(i) for f in own]))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _seeds(bands: int) -> list[int]:
    """Constants that permute hashes by exclusive or, from a multiplicative rule."""
    out = [(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) for k in range(1, bands + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _xor_min(hashes: Column, seed: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(seed)))


class Template:
    """A template's shingles and band values, computed by the same expressions as the windows'."""

    def __init__(self, name: str, k: int, hashes: list[int], bands: list[int]):
        self.name, self.k, self.hashes, self.bands = name, k, hashes, bands
        # the least power of two of at least one and a half times its shingles
        self.window = 2
        while self.window < 1.5 * len(hashes):
            self.window *= 2


def prepare(spark: SparkSession, templates: dict[str, str], bands: int = BANDS) -> list[Template]:
    """One row a template comes to the driver; the templates are a bounded argument."""
    rows = spark.createDataFrame([(name, text, min(SHINGLE, max(1, len(text.split())))) for name, text in templates.items()], "name string, text string, k int")
    seeds = F.array(*[F.lit(s) for s in _seeds(bands)])
    out = []
    for k in range(1, SHINGLE + 1):
        h = F.array_distinct(shingles(words(F.col("text")), k))
        got = rows.filter(F.col("k") == k).select("name", h.alias("h")).filter(F.size("h") > 0).select("name", "h", F.transform(seeds, lambda s: _xor_min(F.col("h"), s)).alias("bands"))
        out += [Template(r["name"], k, list(r["h"]), list(r["bands"])) for r in got.collect()]
    order = list(templates)
    return sorted(out, key=lambda t: order.index(t.name))


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, least: float = 0.8) -> DataFrame:
    """doc_id, licenses (names joined by commas, in the templates' order), n_licenses, containment (the highest), n_words.

    A row's work is in that row: no shuffle, no skew. A window's band value can equal a template's only if the window
    holds the very shingle that gave it; texts and windows with none of those shingles are passed over before any band
    is computed, which loses nothing. Null and empty texts have no license. Repeated rows repeat; an empty table gives
    no rows; a table of templates without words matches nothing.
    """
    ready = prepare(docs.sparkSession, TEMPLATES if templates is None else templates, bands)
    seeds = _seeds(bands)
    rows = scattered(docs, "doc_id", "text").select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    sizes = sorted({t.k for t in ready})
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), *[shingles(F.col("w"), k).alias(f"h{k}") for k in sizes])
    classes = sorted({(t.k, t.window) for t in ready})
    kept = {}
    for k, size in classes:
        lead = _longs(sorted({b ^ s for t in ready if (t.k, t.window) == (k, size) for b, s in zip(t.bands, seeds)}))
        h, stride = F.col(f"h{k}"), size // 3 + 1
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(stride))
        windows = F.filter(F.transform(starts, lambda s: F.slice(h, s + 1, size)), lambda x: F.arrays_overlap(x, lead))
        kept[f"x{k}_{size}"] = F.when(F.arrays_overlap(h, lead), windows)
    rows = rows.select("doc_id", "n_words", *[c.alias(name) for name, c in kept.items()])
    found = []
    for t in ready:
        pairs = F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), F.lit(b).cast("long").alias("value")) for s, b in zip(seeds, t.bands)])
        own = _longs(t.hashes)
        retrieved = F.filter(F.col(f"x{t.k}_{t.window}"), lambda x: F.exists(pairs, lambda p: _xor_min(x, p["seed"]) == p["value"]))
        share = F.array_max(F.transform(retrieved, lambda x: F.size(F.array_intersect(x, own)) / F.lit(float(len(t.hashes)))))
        found.append(F.struct(F.lit(t.name).alias("name"), F.coalesce(share, F.lit(0.0)).alias("share")))
    empty = F.array().cast("array<struct<name:string,share:double>>")
    some = F.filter(F.array(*found), lambda f: f["share"] >= least) if found else empty
    any_left = F.coalesce(*[F.col(c) for c in kept]) if kept else F.lit(None)
    rows = rows.select("doc_id", "n_words", F.when(any_left.isNotNull(), some).otherwise(empty).alias("found"))
    return rows.select(
        "doc_id",
        F.array_join(F.transform("found", lambda f: f["name"]), ",").alias("licenses"),
        F.size("found").cast("long").alias("n_licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("containment"),
        "n_words",
    )
