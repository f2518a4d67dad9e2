"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates are runs of lower-case letters and digits, and shingles of five of them. A window is ``WINDOW`` shingles,
every ``STRIDE``; ``BANDS`` permutations of the shingle hashes give a minimum each, and one equal minimum in a band is enough. A
window that shares at least half of its shingles with a window of a template collides with a probability of
``1 - (1 - 1/3) ** BANDS`` or more (two sets of equal size that share half have a Jaccard of 1/3): above 0.96 with 8 bands for that single worst window, and an intact
copy shows several windows of a Jaccard of 1, which always collide. Templates of fewer than ``WINDOW`` shingles are looked up with windows of one shingle, which collide
surely. A retrieved template is in the document if ``CONTAINED`` of its distinct shingles are, counted on the words themselves.

All is native: arrays are built, permuted, cut and filtered within a row; only retrieved pairs become rows. The templates are a fixed,
small table, which bounds the one broadcast. Null and short texts contain nothing; repeated rows
are scanned each for itself; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

WIDTH = 5
WINDOW, STRIDE, BANDS = 8, 4, 8
CONTAINED = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: public licence statements and notices
TEMPLATES = [
    ("cc-by-nc-4.0-statement", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-statement", "Licensed under CC BY 4.0."),
    ("mit-statement", "Released under the MIT License."),
    ("apache-2.0-statement", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-statement", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                          "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                       "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("([a-z0-9]+)"))


def places(n: Column) -> Column:
    """0 .. n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column) -> Column:
    return F.transform(places(F.size(w) - WIDTH + 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(F.transform(places(F.size(w) - WIDTH + 1), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WIDTH)])))


def band_mask(k: int) -> int:
    """A constant whose leading bits differ for each band, so that the minima come from different parts of the hashes."""
    value = (k << 61 | (0x9E3779B97F4A7C15 * (k + 1) % (1 << 61))) % (1 << 64)
    return value - (1 << 64) if value >= 1 << 63 else value


def windows(hashes: Column, stride: int) -> Column:
    return F.transform(places(F.ceil(F.size(hashes) / stride).cast("int")), lambda j: F.slice(hashes, j * stride + 1, WINDOW))


def minima(windows: Column, band: int) -> Column:
    """The least permuted hash of each window."""
    return F.transform(windows, lambda win: F.array_min(F.transform(win, lambda x: x.bitwiseXOR(F.lit(band_mask(band))))))


def template_table(spark, templates) -> DataFrame:
    """(license, shingles, band, key): band -1 holds single shingles of the short templates."""
    rows = (spark.createDataFrame(templates, "license string, text string").withColumn("w", words(F.col("text")))
            .select("license", shingle_texts(F.col("w")).alias("shingles"), shingle_hashes(F.col("w")).alias("h")))
    keys = F.array(*[F.struct(F.lit(k).alias("band"), minima(windows(F.col("h"), 1), k).alias("keys")) for k in range(BANDS)])
    long = rows.filter(F.size("h") >= WINDOW).select("license", "shingles", F.explode(keys).alias("k")).select("license", "shingles", "k.band", F.explode("k.keys").alias("key"))
    short = rows.filter(F.size("h") < WINDOW).select("license", "shingles", F.lit(-1).alias("band"), F.explode("h").alias("key"))
    return long.unionByName(short).distinct()


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(id, license, containment) of every document and template that it contains."""
    known = template_table(docs.sparkSession, templates)
    keys: dict[int, list[int]] = {}
    for r in known.select("band", "key").distinct().collect():          # as many as the templates have windows
        keys.setdefault(r["band"], []).append(r["key"])
    hit = lambda found, band: F.transform(F.filter(found, lambda m: m.isin(keys[band])), lambda m: F.struct(F.lit(band).alias("band"), m.alias("key")))
    hashed = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("w", words(F.col("text")))
              .withColumn("h", shingle_hashes(F.col("w"))).withColumn("win", windows(F.col("h"), STRIDE)))
    found = [hit(F.col("h") if b < 0 else minima(F.col("win"), b), b) for b in sorted(keys)]
    # templates of the windows that hit, each once a row: the few templates are tried against the row's keys
    names = known.groupBy("license", "shingles").agg(F.collect_set(F.struct("band", "key")).alias("keys")).collect()
    tried = F.concat(*[F.when(F.arrays_overlap("found", F.array(*[F.struct(F.lit(k["band"]).alias("band"), F.lit(k["key"]).alias("key")) for k in t["keys"]])),
                              F.array(F.struct(F.lit(t["license"]).alias("license"), F.array(*map(F.lit, t["shingles"])).alias("shingles"))))
                       .otherwise(F.array().cast("array<struct<license:string,shingles:array<string>>>")) for t in names])
    pairs = (hashed.select("id", "w", F.array_distinct(F.concat(*found)).alias("found"))
             .select("id", "w", F.explode(F.when(F.size("found") > 0, tried)).alias("t")))
    share = F.size(F.array_intersect("t.shingles", shingle_texts(F.col("w")))) / F.size("t.shingles")
    return pairs.select(F.col("id").alias(id_col), "t.license", share.alias("containment")).filter(F.col("containment") >= contained)


SQL = r"""
WITH templates(license, text) AS (VALUES {values}),
tokens AS (
  SELECT license, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z0-9]+') AS w FROM templates),
template_shingles AS (
  SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tokens)),
sizes AS (SELECT license, count(*) AS n FROM template_shingles GROUP BY license),
doc_tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[a-z0-9]+') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_tokens))
SELECT d.doc_id, t.license, count(*) / max(s.n) AS containment
FROM doc_shingles d JOIN template_shingles t USING (shingle) JOIN sizes s USING (license)
GROUP BY d.doc_id, t.license HAVING count(*) / max(s.n) >= 0.8
""".replace("{values}", ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)).replace("{upper}", UPPER).replace("{lower}", LOWER)


@query("op4_license_scan", SQL)
def op4(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "containment")
