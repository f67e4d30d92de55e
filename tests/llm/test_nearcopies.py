from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import documents, empty, order, pairs, sample
from landtrace.llm import nearcopies
from landtrace.llm.nearcopies import keep_one_of_each, most_shared, prefix, sketch
from landtrace.llm.simhash import fingerprint


def shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Lists of rows (id, text) that reach each other over pairs of similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    out = {}
    for k, r in enumerate(rows):
        out.setdefault(find(k), []).append(r)
    return list(out.values())


def check(docs):
    """One row of each group is kept, with the smallest id."""
    rows = pairs(docs)
    kept = Counter(pairs(corpus_pipeline.near_dedup(docs.sparkSession, docs, "")))
    found = groups(rows)
    assert sum(kept.values()) == len(found)
    for g in found:
        mine = [r for r in set(g) if kept[r]]
        assert len(mine) == 1 and kept[mine[0]] == 1 and order(mine[0]) == min(map(order, g))
    return found


def changed(rng, words, similarity):
    """Words with so many replaced that the similarity is near ``similarity``."""
    words = list(words)
    n = round(len(words) * (1 - similarity) / (1 + similarity) / 5)
    for k in rng.sample(range(len(words)), max(1, n)):
        words[k] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("stars, crowd, block", [(0, 64, 512), (0, 2, 7), (3, 64, 512), (1, 2, 512)])
def test_near_copies_from_080_on_go(spark, monkeypatch, stars, crowd, block):
    monkeypatch.setattr(nearcopies, "STARS", stars)
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts.append(base)
        texts += [changed(rng, base, rng.uniform(0.7, 0.97)) for _ in range(3)]
    phrase = [f"p{k}" for k in range(40)]  # common to many that are no copies
    texts += [phrase + [f"u{rng.randrange(10**9)}" for _ in range(30)] for _ in range(40)]
    rng.shuffle(texts)
    found = check(documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]))
    assert 100 < len(found) < 250


def test_odd_rows_and_sample(spark, sf_dir):
    check(documents(spark))
    check(sample(spark, sf_dir))
    assert keep_one_of_each(empty(spark)).count() == 0
    docs = documents(spark)
    assert keep_one_of_each(docs).schema == docs.schema


def test_many_keys_meet_their_texts_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "KEEP", 0)
    check(documents(spark))


def test_rows_without_an_id_all_stay(spark):
    texts = [(None, " ".join(f"n{k}w{i}" for i in range(30))) for k in range(20)]
    texts += [(7, " ".join(f"s{k}w{i}" for i in range(30))) for k in range(5)]
    texts += [(None, texts[3][1]), (7, texts[22][1]), (8, texts[22][1])]
    docs = documents(spark, texts)
    assert Counter(pairs(corpus_pipeline.near_dedup(spark, docs, ""))) == Counter(texts[:25])


def test_stage_searches_by_fingerprint(spark, monkeypatch):
    """SimHash finds the copies it can by itself, and what it links is confirmed by the sets."""
    rng = random.Random(9)
    base = [[f"f{k}w{rng.randrange(10**6)}" for _ in range(400)] for k in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base] + ["near", "far"]
    linked = []
    real = nearcopies.links

    def links(prints):
        linked.append(prints.count())
        return real(prints).unionByName(prints.limit(1).select(F.col("_node").alias("a"), (F.col("_node") * 0).alias("b")))

    monkeypatch.setattr(nearcopies, "links", links)
    monkeypatch.setattr(nearcopies, "STARS", 0)
    monkeypatch.setattr(nearcopies, "_rest", lambda buckets, rows, tested, similarity: tested.limit(0))
    docs = documents(spark, list(enumerate(texts)))
    kept = Counter(pairs(corpus_pipeline.near_dedup(spark, docs, "")))
    near = [k for k in range(12) if (fingerprint(texts[k].encode()) ^ fingerprint(texts[k + 12].encode())).bit_count() <= 4]
    assert linked and len(near) > 6
    assert kept == Counter((k, t) for k, t in enumerate(texts) if k - 12 not in near)


def test_prefix_puts_common_shingles_last():
    shingles = np.arange(1, 11, dtype=np.uint64)
    common, place = np.array([1, 3], np.uint64), np.array([2, 1])
    assert prefix(shingles, common, place).tolist() == [2, 4, 5]
    assert prefix(shingles[:3], common, place).tolist() == [2]
    assert prefix(shingles, common[:0], place[:0]).tolist() == [1, 2, 3]


def test_sketches_never_bound_too_low():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 9000), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, rng.integers(0, len(x) + 1)),
                                      rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)]))
        one, two = (np.frombuffer(sketch(s), np.uint8) for s in (x, y))
        assert most_shared(one, two[None, :])[0] >= len(np.intersect1d(x, y))
        assert most_shared(one, one[None, :])[0] == len(x)
    assert sketch(np.arange(300, dtype=np.uint64) * np.uint64(4096)) == b""


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Without SimHash and stars all pairs of a group are left; few per node are compared, and no link is lost."""
    compared = []
    verified = nearcopies._verified

    def counting(found, *rest):
        compared.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(nearcopies, "_verified", counting)
    monkeypatch.setattr(nearcopies, "fingerprint_pairs", lambda nodes: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(nearcopies, "STARS", 0)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1:]) for k in range(120)] + ["another text " + "x y z " * k for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nearcopies.near_copies(docs).collect()
    roots = {r["_id"]: r["_root"] for r in found}
    assert len(found) == len(texts) and len({roots[k] for k in range(120)}) == 1
    assert roots[120] != roots[0]
    assert sum(compared) <= 2 * nearcopies.CHOICES * 120
