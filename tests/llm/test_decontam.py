from __future__ import annotations

import re
from collections import Counter

import pytest

from fixtures import LINES, PASSAGE, documents, empty, pairs, sample
from landtrace.llm import decontam
from landtrace.llm.decontam import contamination, keep_clean


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, tuple(w))] if 0 < len(w) < 10 else [(i, tuple(w[k:k + 10])) for k in range(len(w) - 9)]
    out = Counter()
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, win in windows:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(i)
        found.discard(None)
        out[(d, len(w), len(hit), len(found), tuple(sorted(map(str, found))), bool(hit))] += 1
    return out


def result(docs, items):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"])
                   for r in contamination(docs, items).collect())


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_every_window(spark, most, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
    items = [(1, " ".join(PASSAGE.split()[3:40])), (2, "line 3 has its own words 9"), (3, None), (4, ""), (5, "word word word word"),
             (6, "ONE"), (None, "a text without an id"), (1, "first text same id"), (10, "ab" * 400), (9, "word " * 11), (9, "word " * 11),
             (12, "žluťoučký ŽLUŤOUČKÝ 中文 文字"), (13, "- - !!"), (14, " ".join(LINES.split()[:30]) + " other end")]
    docs = documents(spark)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _words string")
    assert result(docs, bench) == brute(pairs(docs), items)


def test_sample_and_empty(spark, sf_dir):
    docs, items = sample(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = result(docs, items)
    assert got == brute(pairs(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    clean = {r["doc_id"] for r in keep_clean(docs, items).collect()}
    assert clean == {k[0] for k in got if not k[5]} and keep_clean(docs, items).columns == docs.columns
    assert contamination(empty(spark), items).count() == 0
    assert contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert keep_clean(docs, items.limit(0)).count() == docs.count()
