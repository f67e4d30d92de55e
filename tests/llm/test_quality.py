from __future__ import annotations

import re
from collections import Counter

import pytest

from fixtures import documents, empty, pairs
from compare import difference
from landtrace.llm.quality import host_quality, keep_good, prior_strength, rule_limit
from landtrace.llm.queries import QUALITY_SQL


def features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_features_and_base_rules(spark):
    docs = documents(spark)
    got = Counter(tuple(r)[:7] for r in host_quality(docs).collect())
    want = Counter()
    for i, t in pairs(docs):
        f = features(t)
        want[(i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0])] += 1
    assert got == want


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    texts = [(i, good + str(i)) for i in range(60)]
    docs = documents(spark, texts).drop("source")
    from pyspark.sql import functions as F

    docs = docs.withColumn("source", F.when(F.col("doc_id") < 20, "bad").otherwise("good")).withColumn(
        "text", F.when(F.col("doc_id").between(2, 19), "too short").otherwise(F.col("text")))
    kept = {r["doc_id"] for r in host_quality(docs).filter("kept").collect()}
    assert kept == set(range(20, 60))
    rows = keep_good(docs)
    assert rows.columns == docs.columns and {r["doc_id"] for r in rows.collect()} == kept


def test_empty_and_prior(spark):
    assert host_quality(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0
    assert prior_strength(0.0, 0.0, 10, 2) == 0.0
    # hosts that differ as chance would have it count for much, hosts that differ widely for little
    assert prior_strength(0.5, 2 * 50 * 50 / 100, 200, 2) == pytest.approx(1e6, rel=1e-3)
    assert prior_strength(0.5, 100.0 * 100 / 100, 200, 2) < 0.1


def test_limit_follows_the_prior(spark):
    """One host of 21 fails a third of its documents, the others one in fifty: it goes, by SQL as well."""
    import duckdb
    from pyspark.sql import functions as F

    texts = [(i, " ".join(f"word{i}of{k}" for k in range(10 if i % (3 if i < 60 else 50) == 0 else 30))) for i in range(1260)]
    docs = documents(spark, texts).withColumn("source", F.concat(F.lit("host"), F.floor(F.col("doc_id") / 60).cast("string")))
    got = host_quality(docs)
    kept = {r["doc_id"] for r in got.filter("kept").collect()}
    assert kept == {i for i in range(60, 1260) if i % 50}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "text").toPandas())
    assert difference(got, con, QUALITY_SQL) is None


def test_limits():
    assert rule_limit(0.02, 1e6) == 0.25 and rule_limit(0.3, 0.0) == 0.5
    assert rule_limit(0.2, 15.0) == pytest.approx(0.5) and rule_limit(0.2, 63.0) == pytest.approx(0.35)
