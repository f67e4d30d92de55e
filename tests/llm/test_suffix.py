from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fixtures import documents, empty, order, pairs, sample
from landtrace.llm import suffixes
from landtrace.llm.common import settle
from landtrace.llm.suffixdedup import dedup_substrings


def brute(rows):
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (order(r), r[2]))
    for i, text, v in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            at = first.setdefault(raw[a:a + 100], (i, v, a))
            if at != (i, v, a):
                gone[a:a + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = bytes(gone).replace(b"\0", b" ").split()
        out.append((i, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(docs, **kw):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
                   for r in dedup_substrings(docs, **kw).collect())


def versions(spark, docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as v").collect()]


@pytest.mark.parametrize("most", [12_000, 1])
def test_against_every_window(spark, sf_dir, most):
    docs = sample(spark, sf_dir).select("doc_id", "text").limit(120)
    docs = settle(docs.unionByName(documents(spark).selectExpr("doc_id + 50 as doc_id", "text")))
    assert result(docs, most=most) == brute(versions(spark, docs))


def test_copies_in_many_batches(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(400)]
    base = " ".join(rng.choices(words, k=150))
    texts = [(i, base[rng.randint(0, 300):] + " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    docs = documents(spark, texts).repartition(20)
    for most in (12_000, 4):
        assert result(docs, most=most) == brute(versions(spark, docs))


def test_empty(spark):
    assert dedup_substrings(empty(spark)).count() == 0


def test_suffix_array_and_prefixes(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 10)
    rng = np.random.default_rng(1)
    for k in range(150):
        n, sigma = int(rng.integers(1, 150)), int(rng.integers(1, 6))
        text = rng.integers(0, sigma, n)
        if k % 3 == 0:
            text = np.tile(text[:max(1, n // 7)], 9)[:n]
            n = len(text)
        plain = text.tolist()
        sa = suffixes.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: plain[i:])
        before, common = suffixes.permuted_common_prefixes(text, sa, 0)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            same = 0
            while max(i, j) + same < n and plain[i + same] == plain[j + same] != 0:
                same += 1
            assert before[i] == j and common[i] == same
