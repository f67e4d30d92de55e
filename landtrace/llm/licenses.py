"""Licence notices in files, and the licence that a file takes over from its directories.

Each line of a file, and the file as a whole, is compared with licence templates by the cosine
of sparse TF-IDF vectors. Document frequencies of the templates' words are counted over the
whole corpus; a word that no template has weighs as if one document had it. By the
Cauchy-Schwarz bound a text can only reach the threshold if it has one of a template's heaviest
words, so only texts with such a word are taken apart; nothing is lost by that. A file without a
notice of its own inherits from the nearest directory above it that has a licence file.

A licence file is one whose path has a licence file's name or whose first line is a notice. If a
directory has several, the first path counts. NULL and empty texts have no notice. A file
without a path lies in the root directory. Repeated rows come out alike. Other columns are not read.
Only the templates' words, a number set by the templates, reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import outer_id, row_id, settle
from landtrace.llm.decontam import plain_words

THRESHOLD = 0.8
SALTS = 32
KEY = ["_id", "_v"]
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
# fixed values: notices as their licences word them
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
                   " compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
                     " provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
                " General Public License as published by the Free Software Foundation, either version 3 of the License,"
                " or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words_of(text: str) -> list[str]:
    """What ``plain_words`` gives, for the templates."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def template_vectors(idf: dict[str, float], templates: Sequence[tuple[str, str]]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, number, word -> weight) with weights of norm one."""
    out = []
    for k, (name, text) in enumerate(templates):
        raw = {w: n * idf[w] for w, n in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append((name, k, {w: x / norm for w, x in raw.items()}))
    return out


def necessary_words(weights: dict[str, float], threshold: float) -> list[str]:
    """The fewest heaviest words without which the cosine stays below the threshold."""
    rest, keys = 1.0, []
    for w in sorted(weights, key=lambda w: (-weights[w], w)):
        if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
            break
        keys.append(w)
        rest -= weights[w] ** 2
    return keys


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def notices(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, v, licence, similarity, opens): the best notice of each file of (_id, _v, _text) that has one."""
    spark = files.sparkSession
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    here = F.array_intersect(plain_words(F.col("_text")), _strings(vocabulary))
    counted = files.select(F.explode(here).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n_files, df = files.count(), {r["w"]: r["n"] for r in counted}
    idf = {w: math.log((1 + n_files) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + n_files) + 1
    vectors = template_vectors(idf, templates)
    keys = _strings(sorted({w for _, _, v in vectors for w in necessary_words(v, threshold)}))

    found = files.filter(F.arrays_overlap(plain_words(F.col("_text")), keys))
    lines = F.split(F.col("_text"), "\n")
    units = F.array_append(lines, F.when(F.size(lines) > 1, F.col("_text")))
    rows = found.select(*KEY, F.posexplode(units).alias("_unit", "_line")).select(
        *KEY, "_unit", plain_words(F.col("_line")).alias("_w")).filter(F.arrays_overlap("_w", keys))
    tf = rows.select(*KEY, "_unit", F.explode("_w").alias("w")).groupBy(*KEY, "_unit", "w").agg(F.count("*").alias("tf"))
    weights = spark.createDataFrame(
        [(w, idf[w], [(k, v[w]) for _, k, v in vectors if w in v]) for w in vocabulary],
        "w string, idf double, at array<struct<k int, x double>>")
    tf = tf.join(F.broadcast(weights), "w", "left")
    x = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    dots = [F.sum(F.coalesce(F.col("tf") * F.col("idf") * F.get(F.filter("at", _is(k)), F.lit(0))["x"], F.lit(0.0))).alias(f"_{k}")
            for _, k, _ in vectors]
    scored = tf.groupBy(*KEY, "_unit").agg(F.sqrt(F.sum(x * x)).alias("_norm"), *dots)
    best = F.greatest(*[F.struct(
        F.round(F.col(f"_{k}") / F.col("_norm"), 9).alias("similarity"), F.lit(name).alias("licence")) for name, k, _ in vectors])
    scored = scored.select(*KEY, (F.col("_unit") == 0).alias("_first"), best.alias("_best")).filter(
        F.col("_best.similarity") >= threshold)
    return scored.groupBy(*KEY).agg(
        F.max("_best").alias("_best"), F.max("_first").alias("_opens")).select(
        *KEY, F.col("_best.licence").alias("_licence"), F.col("_best.similarity").alias("_similarity"), "_opens")


def _is(k: int):
    return lambda a: a["k"] == k


def _inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """(dir, licence, from): for each directory the nearest licence file's, at or above it."""
    granted = files.join(own, KEY).filter(F.col("_opens") | F.col("_path").rlike(FILE_NAME))
    granted = granted.groupBy("_dir").agg(F.min(F.struct("_path", "_licence")).alias("_first")).select(
        F.col("_dir").alias("_from"), F.col("_first._licence").alias("_licence"))
    parts = F.split("_dir", "/")
    above = F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.lit(""))
    dirs = files.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_from"))
    near = dirs.join(granted, "_from").groupBy("_dir").agg(
        F.max(F.struct(F.length("_from").alias("n"), "_from", "_licence")).alias("_near"))
    return near.select("_dir", F.col("_near._from").alias("_from"), F.col("_near._licence").alias("_taken"))


def scan_licences(
    docs: DataFrame, path, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Every file's licence, where it comes from, and the similarity of its own notice.

    ``path`` is a column of paths with ``/``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    where = F.coalesce(path.cast("string"), F.lit(""))
    rows = docs.select(row_id(id_col).alias("_id"), F.xxhash64(text).alias("_v"), where.alias("_path"), text.alias("_text"))
    own = settle(notices(rows.select(*KEY, "_text"), templates, threshold))
    files = rows.select(*KEY, "_path", F.regexp_extract("_path", r"^(.*)/[^/]*$", 1).alias("_dir"))
    taken = _inherited(files, own).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a directory may hold a third of all files
    files = files.withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    out = files.join(own, KEY, "left").join(taken, ["_dir", "_salt"], "left")
    return out.select(
        outer_id().alias(id_col), F.col("_path").alias("path"), F.coalesce("_licence", "_taken").alias("licence"),
        F.when(F.col("_licence").isNotNull(), "own").when(F.col("_taken").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("_licence").isNull(), F.col("_from")).alias("inherited_from"), F.round("_similarity", 6).alias("similarity"))
