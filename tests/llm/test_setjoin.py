from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fixtures import documents, empty, pairs, sample
from landtrace.llm import setjoin
from landtrace.llm.setjoin import (
    PROBE, EXACT, DOUBLE, allocate, band_edges, entries, jaccard_components, linked, most_apart, schemes)


def shingles(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, num=85, den=100, words=4):
    """Counter of (id, set size, component) by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.75:
            words.insert(at, f"more{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def families(seed, count=40):
    """Texts of many sizes with chains of edited copies around the threshold, some with a common passage."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for f in range(count):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 9, 10, 12, 17, 25, 40, 70, 150, 400]))]
        if f % 3 == 0:
            base = common + base
        now = base
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(now)))
            now = edited(rng, rng.choice([base, now]), rng.randrange(0, 2 + len(base) // 40))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("weight", [500_000, 200])
def test_against_all_pairs(spark, sf_dir, weight):
    rows = families(7) + [(10_000 + i, t) for i, t in pairs(sample(spark, sf_dir))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = Counter(map(tuple, jaccard_components(docs, weight=weight).collect()))
    assert found == brute(rows)


def test_other_parameters(spark):
    rows = families(11, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, jaccard_components(docs, words=2, similarity=(6, 10)).collect()))
    assert found == brute(rows, 6, 10, 2)


def test_odd_rows(spark):
    docs = documents(spark)
    assert Counter(map(tuple, jaccard_components(docs).collect())) == brute(pairs(docs))
    assert jaccard_components(empty(spark)).count() == 0


def test_many_near_copies_of_one_text(spark, monkeypatch):
    """A hot group in many blocks, partly too far apart to be linked; no id is broadcast."""
    monkeypatch.setattr(setjoin, "KEEP", 0)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 7)))) for i in range(200)] + [(900 + i, " ".join(base)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, jaccard_components(docs, weight=2000).collect()))
    assert found == brute(rows)


@pytest.mark.parametrize("docs", [10.0, 1e6, 1e10])
def test_schemes_find_every_partner(docs):
    """Similar sets meet in the units that their scheme asks for, whichever of the two searches."""
    rng = np.random.default_rng(5)
    similarity = (85, 100)
    edges = band_edges(700, similarity)
    plans = schemes(edges, [docs] * len(edges), similarity)
    assert edges[0] == 6 and all(p.units >= most_apart(e, similarity) + 1 for p, e in zip(plans, edges[1:]))
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(7, 700))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both) or max(len(x), len(y)) > edges[-1]:
            continue
        tried += 1
        plan = plans[int(np.searchsorted(edges, max(len(x), len(y)))) - 1]
        ours, theirs = (dict(zip(*[a.tolist() for a in entries(s, plan)])) for s in (x, y))
        for a, b in ((ours, theirs), (theirs, ours)):
            units = sum(2 if f & DOUBLE else 1 for k, f in a.items() if k in b and b[k] & PROBE and (f | b[k]) & EXACT)
            assert units >= plan.need
    assert tried > 500


def test_allocation_follows_cost():
    """Deletion entries pay for small sets and large tables; more documents never get fewer units."""
    few, many = allocate(1, 7, 9, 10, (85, 100)), allocate(1, 7, 9, 1e9, (85, 100))
    assert many.deep > 0 and many.units >= few.units - 1
    assert allocate(5, 250, 400, 1e9, (85, 100)).units > allocate(5, 250, 400, 10, (85, 100)).units


def test_linked_within_a_task():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.delete(base, range(k)) for k in (0, 2, 4, 30)]
    assert len(linked(sets, [0] * 4, [0, 1, 2, 3], (85, 100))) == 2
    assert linked(sets, [0, 0, 0, 0], [5, 5, 5, 6], (85, 100)) == []
    assert {frozenset(p) for p in linked(sets[:3], [0, 0, 1], [0, 1, 2], (95, 100))} == {frozenset({1, 2})}


def test_smallest_sets_of_a_scheme_seldom_search_empty_segments():
    """A scheme's smallest sets lie below its band; segments that are empty in them are empty in many others."""
    rng = np.random.default_rng(6)
    edges = band_edges(400, (85, 100))
    plans = schemes(edges, [40_000.0] * len(edges), (85, 100))
    for plan, low in zip(plans, edges):
        if low < 80:
            continue
        empty = set(entries(np.empty(0, np.uint64), plan)[0].tolist())
        searched = 0
        for _ in range(2000):
            keys, flags = entries(rng.integers(0, 1 << 63, -(-85 * (low + 1) // 100), dtype=np.uint64), plan)
            searched += sum(1 for k, f in zip(keys.tolist(), flags.tolist()) if f & PROBE and k in empty)
        assert searched <= 2


def test_meetings_need_a_size_that_fits(spark):
    """Nodes meet nodes of another block that search there and have another root and a size that can be similar."""
    nodes = [(1, 100, 1), (2, 300, 1), (3, 110, 3), (4, 100, 3), (5, 1000, 3)]
    shared = [(s, n, PROBE + EXACT if n in (1, 3) else EXACT, 5) for s in (7, 8) for n, *_ in nodes]
    shared = spark.createDataFrame(shared, "_s long, _node long, _f byte, _c long")
    blocks = spark.createDataFrame([(n, size, block, n) for n, size, block in nodes], "_node long, _n long, _block long, _root long")
    groups = setjoin._meetings(shared, blocks, (85, 100)).select("_g1", "_g2", "_node", "_side").collect()
    assert sorted(map(tuple, groups)) == [(1, 3, 1, 0), (1, 3, 3, 1), (1, 3, 4, 1)]
