from __future__ import annotations

import math
import random

import numpy as np
import pytest

from landtrace.llm.whitening import bit_products, fit, scatter, whiten, whole_vectors


def rows_of(spark, rows):
    return spark.createDataFrame(
        [(i, v, "x", k, 1.0) for k, (i, v) in enumerate(rows)],
        "vec_id long, embedding array<float>, component string, n int, whitened double")


def exact(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    products = [[sum(r[a] * r[b] for r in x) for b in range(len(sums))] for a in range(len(sums))]
    return x, sums, products


@pytest.mark.parametrize("top", [0, 1, 9, 31, 62])
def test_bit_products(top):
    rng = np.random.default_rng(top)
    block = rng.integers(-(1 << top), (1 << top) + 1, (200, 5))
    sums, products = bit_products(block)
    x = block.astype(object)
    assert (sums == x.sum(axis=0)).all() and (products == x.T @ x).all()


def test_scatter_is_exact(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 3), rng.uniform(-1, 1), 1e15 * rng.random(), -5.0, rng.gauss(7, 1e-3)] for _ in range(300)]
    rows = rows_of(spark, list(enumerate(vectors))).repartition(7)
    kept, width = whole_vectors(rows, "vec_id", "embedding")
    found = scatter(kept, width)
    _, sums, products = exact(vectors)
    assert (found.n, found.sums, found.products) == (300, sums, products)


def test_against_plain_numbers(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12))
    vectors = (rng.normal(size=(500, 12)) * np.linspace(3, 0.2, 12) @ mix).astype(np.float32).tolist()
    bad = [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [math.nan] * 12), (904, [math.inf] + [0.0] * 11), (905, [1.0] * 3)]
    good = list(enumerate(vectors)) + [(None, vectors[0]), (7, vectors[7])]
    found = whiten(rows_of(spark, good + bad), 8).toPandas()
    assert len(found) == len(good) * 8 and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    x, sums, _ = exact([v for _, v in good])
    n = len(x)
    x = np.array(x, float)
    off = x - np.array(sums) / n
    values, vecs = np.linalg.eigh(off.T @ off / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    want = {}
    for (i, _), r, xi in zip(good, off, x):
        d = sum((n * int(c) - s) ** 2 for c, s in zip(xi, sums))
        want.setdefault(i, []).append((d, r @ vecs[:, :8] / np.sqrt(values[:8])))
    signs = {}
    for r in found.itertuples():
        i = None if r.vec_id != r.vec_id else int(r.vec_id)
        d, w = want[i][0]
        assert int(r.deviation) == d and r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
        expected = w[r.component - 1]
        if r.component not in signs and abs(expected) > 1e-3:
            signs[r.component] = math.copysign(1, expected * r.whitened)
        if r.component in signs:
            assert r.whitened * signs[r.component] == pytest.approx(expected, rel=1e-6, abs=1e-8)


def test_without_variance_and_empty(spark):
    same = whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in same)
    line = whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and line[0].identity_error < 1e-9
    far = whiten(rows_of(spark, [(1, [3e38, 2.0]), (2, [-3e38, 2.5])])).collect()
    assert len(far) == 4
    empty = whiten(rows_of(spark, [(1, None)]))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kept, width = whole_vectors(rows, "vec_id", "embedding")
    model = fit(scatter(kept, width), 8)
    found = whiten(rows)
    assert found.count() == 8 * rows.count() and list(model.variances) == sorted(model.variances, reverse=True)
    assert found.select("identity_error").first()[0] < 1e-6
