from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from fixtures import documents, empty, order, pairs, sample
from landtrace.llm.licenses import FILE_NAME, TEMPLATES, necessary_words, scan_licences, words_of
from landtrace.llm.queries import document_path


def vector(words, idf, unseen):
    return {w: n * idf.get(w, unseen) for w, n in Counter(words).items()}


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
    return sum(x * b.get(w, 0) for w, x in a.items()) / (na * nb) if na and nb else 0.0


def brute(files):
    """files: (id, path, text) -> Counter of (id, path, licence, origin, from)."""
    vocabulary = {w for _, t in TEMPLATES for w in words_of(t)}
    df = Counter(w for _, _, t in files for w in set(words_of(t or "")) & vocabulary)
    n = len(files)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocabulary}
    unseen = math.log(1 + n) + 1
    templates = [(name, vector(words_of(t), idf, unseen)) for name, t in TEMPLATES]
    own, granted = {}, {}
    for i, path, text in files:
        units = (text or "").split("\n")
        best = opens = None
        for k, unit in enumerate(units + ([text] if len(units) > 1 else [])):
            v = vector(words_of(unit), idf, unseen)
            top = max((round(cosine(v, t), 9), name) for name, t in templates)
            if top[0] >= 0.8:
                opens = opens or k == 0
                best = max(best or top, top)
        own[i, path, text] = best
        if best and (opens or re.search(FILE_NAME, path or "")):
            d = (path or "").rpartition("/")[0]
            granted[d] = min(granted.get(d, (path or "", best[1])), (path or "", best[1]))
    out = Counter()
    for f in files:
        best, d = own[f], (f[1] or "").rpartition("/")[0]
        if best:
            out[(f[0], f[1] or "", best[1], "own", None, round(best[0], 6))] += 1
            continue
        while d and d not in granted:
            d = d.rpartition("/")[0]
        found = granted.get(d)
        out[(f[0], f[1] or "", found and found[1], found and "inherited", d if found else None, None)] += 1
    return out


def test_against_plain_vectors(spark):
    texts = [
        ("p/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"
                      " and associated documentation files"),
        ("p/a.py", "code without a notice"), ("p/sub/LICENSE.txt", "# Licensed under the Apache License, Version 2.0."),
        ("p/sub/b.py", "more code"), ("p/sub/deep/er/c.py", None), ("p/x/y.py", "# Released under the MIT license!\ncode"),
        ("p/x/z.py", ""), ("q/a.py", "nothing above"), (None, "This work is licensed under the GNU General Public License, version 3."),
        ("r/COPYING", "not a licence at all"), ("r/a.py", "licensed to nobody"), ("q/b/c.py", "intro\n Licensed under CC BY-NC 4.0. \nmore"),
        ("top.py", "x"), ("q/b/d.py", "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    rows = [(k, p, t) for k, (p, t) in enumerate(texts)]
    docs = spark.createDataFrame([(k, p, t, "w", 1) for k, p, t in rows], "doc_id long, p string, text string, w string, _salt int")
    got = Counter(map(tuple, scan_licences(docs, F.col("p")).collect()))
    assert got == brute(rows)
    assert sum(1 for k in got if k[3] == "inherited") >= 4


def test_sample_odd_rows_and_empty(spark, sf_dir):
    docs = sample(spark, sf_dir)
    rows = [tuple(r) for r in docs.select("doc_id", document_path(), "text").collect()]
    got = Counter(map(tuple, scan_licences(docs, document_path()).collect()))
    assert got == brute(rows) and any(k[3] == "own" for k in got)
    odd = documents(spark)
    out = Counter(r["doc_id"] for r in scan_licences(odd, F.col("source")).collect())
    assert out == Counter(i for i, _ in pairs(odd)) and order((None,)) < order((1,))
    assert scan_licences(empty(spark), F.col("source")).count() == 0


def test_bound_loses_nothing():
    weights = {"a": 0.8, "b": 0.5, "c": math.sqrt(1 - 0.64 - 0.25)}
    assert necessary_words(weights, 0.8) == ["a"]
    assert necessary_words({f"w{i}": 0.1 for i in range(100)}, 0.8).__len__() == 37
