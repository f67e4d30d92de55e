from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fixtures import documents, empty, pairs, sample
from landtrace.llm.simhash import Plan, bit_pairs, keep_one, links, make_plan, near_duplicates


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, distance=4):
    """node -> smallest node reached; prints: node -> fingerprints."""
    nodes = sorted(prints, key=lambda n: (n is not None, n or 0))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if any((x ^ y).bit_count() <= distance for x in prints[a] for y in prints[b]):
                x, y = find(a), find(b)
                if x != y:
                    low = min(x, y, key=lambda n: (n is not None, n or 0))
                    root[x] = root[y] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_against_all_pairs(spark, sf_dir, bucket):
    docs = sample(spark, sf_dir).select("doc_id", "text").unionByName(documents(spark).selectExpr("doc_id + 1000 as doc_id", "text"))
    rows = [(i, fingerprint(t)) for i, t in pairs(docs)]
    by_node = {}
    for i, p in rows:
        by_node.setdefault(i, set()).add(p)
    root = roots(by_node)
    want = Counter((i, f"{p:016x}", root[i]) for i, p in rows)
    assert Counter(map(tuple, near_duplicates(docs, bucket=bucket).collect())) == want


@pytest.mark.parametrize("thresholds", [[2, 1], [1, 1, 0], [0, 2, 0], [-1, 2, 1, -1], None])
def test_links_with_unequal_thresholds(spark, thresholds):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = set()
    for s in seeds.tolist():
        for _ in range(6):
            for b in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                s ^= 1 << b
            prints.add(s)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "_fp long, _node long")
    plan = None
    if thresholds:
        m = len(thresholds)
        plan = Plan([list(range(64))[k::m] for k in range(m)], thresholds)
    found = [(r["a"], r["b"]) for r in links(rows, plan=plan).collect()]
    root = list(range(len(prints)))
    for _ in prints:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(enumerate(root)) == roots({i: {p} for i, p in enumerate(prints)})


def test_plan_covers_the_distance(spark):
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 2, (3000, 64))
    raw[:, 40:] = raw[:, 39:40] ^ (rng.random((3000, 24)) < 0.02)  # correlated bits
    raw[:, 5] = 1
    values = [int("".join(map(str, r)), 2) for r in raw.tolist()]
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "_fp long")
    both = bit_pairs(rows)
    assert both[63 - 5, 63 - 5] == 3000
    for n in (10, 3000, 1e6, 1e10):
        plan = make_plan(both, n)
        assert sorted(b for part in plan.parts for b in part) == list(range(64))
        assert sum(t + 1 for t in plan.thresholds) >= 5


def test_keep_one_and_empty(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    # fingerprints are the nodes: a row for each component of them, whichever rows share an id
    rows = pairs(docs)
    root = roots({fingerprint(t): {fingerprint(t)} for _, t in rows})
    groups = {}
    for i, t in rows:
        groups.setdefault(root[fingerprint(t)], []).append(i)
    first = [min(g, key=lambda i: (i is not None, i or 0)) for g in groups.values()]
    assert Counter(first) == Counter(r["doc_id"] for r in kept.collect())
    assert near_duplicates(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


def test_rows_without_an_id_are_not_one_node(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in range(6)]
    docs = documents(spark, [(None, texts[0]), (None, texts[1]), (5, texts[1]), (6, texts[2]), (6, texts[3]), (7, texts[3]), (8, texts[4]),
                             (8, texts[4])])
    kept = Counter(pairs(keep_one(docs)))
    assert kept == Counter([(None, texts[0]), (None, texts[1]), (6, texts[2]), (6, texts[3]), (8, texts[4])])
    # one row links two others only if it is near both
    docs = documents(spark, [(3, texts[0]), (3, texts[1]), (1, texts[0]), (2, texts[1])])
    got = Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == Counter([(1, 1), (3, 1), (2, 2), (3, 2)])
