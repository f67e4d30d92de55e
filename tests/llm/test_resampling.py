from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fixtures import documents, empty, pairs, sample
from landtrace.llm.resampling import resample


def features(text, low, high):
    low_case = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low_case)
    runs = [" ".join(words[i:i + s]) for s in range(low, high + 1) for i in range(len(words) - s + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def brute(rows, target, low, high, buckets, share, min_words):
    found = [features(t, low, high) for _, t in rows]
    s = Counter(h % buckets for _, f in found for h in f)
    t = Counter(h % buckets for x in target for h in features(x, low, high)[1])
    total, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in range(buckets)]
    out = []
    for (i, text), (n, f) in zip(rows, found):
        weight = sum(gain[h % buckets] for h in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(able) * share[0] // share[1]
    ranks = {}
    for k, r in enumerate(able[:drawn]):
        ranks.setdefault(r, []).append(k + 1)
    return Counter((r[0], *r[2:], ranks[r].pop(0) if ranks.get(r) else None) for r in out)


@pytest.mark.parametrize("low,high,buckets,share,min_words", [
    (1, 1, 10_000, (10, 100), 20), (1, 3, 97, (50, 100), 5), (2, 2, 1000, (100, 100), 0)])
def test_against_plain_loops(spark, sf_dir, low, high, buckets, share, min_words):
    docs = sample(spark, sf_dir).select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resample(docs, bench, share, low, high, buckets, min_words)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    target = [r["text"] for r in bench.collect()]
    assert Counter(map(tuple, found.collect())) == brute(pairs(docs), target, low, high, buckets, share, min_words)


def test_odd_rows(spark):
    docs, target = documents(spark), documents(spark, [(1, "One two"), (1, None), (None, "word passage1 own")])
    found = Counter(map(tuple, resample(docs, target, (100, 100), 1, 2, 50, 1, target_id="doc_id").collect()))
    want = brute(pairs(docs), [t for _, t in pairs(target)], 1, 2, 50, (100, 100), 1)
    assert Counter({k[:4]: 0 for k in found}) == Counter({k[:4]: 0 for k in want})
    assert sorted(k[4] for k in found.elements() if k[4]) == sorted(k[4] for k in want.elements() if k[4])
    by_rank = {k[4]: k for k in found if k[4]}
    assert [by_rank[r][3] for r in sorted(by_rank)] == sorted((k[3] for k in by_rank.values()), reverse=True)


def test_empty_tables(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert resample(empty(spark), bench).count() == 0
    docs = sample(spark, sf_dir).limit(30)
    assert resample(docs, bench.limit(0)).count() == 30


def test_a_line_that_most_documents_share(spark, sf_dir):
    rows = [(i, f"the very common line\nown words {i}\nthe very common line" + "\nlast" * (i % 3)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame([(1, "common words 7")], "item_id long, text string")
    found = Counter(map(tuple, resample(docs, bench, (1, 3), 1, 3, 64, 2).collect()))
    assert found == brute(rows, ["common words 7"], 1, 3, 64, (1, 3), 2)
