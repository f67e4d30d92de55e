from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from landtrace.llm import components as module
from landtrace.llm.components import components


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def smallest(pairs):
    """node -> smallest node reachable, of nodes that aren't their own."""
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root if find(k) != k}


@pytest.mark.parametrize("per_task", [100_000, 50])
def test_smallest_reachable_node_in_tasks_by_links(many_partitions, monkeypatch, per_task):
    """Few links are one task, whatever the shuffle partitions; more are several tasks."""
    monkeypatch.setattr(module, "LINKS", per_task)
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)]
    pairs += [(5000, 5000 + k) for k in range(100)] + pairs[:20]
    found = components(many_partitions.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == smallest(pairs)
    assert found.count() == len(smallest(pairs))
    used = found.select(F.spark_partition_id()).rdd.getNumPartitions()
    assert used == 1 if per_task > len(pairs) else 1 < used < 10


def test_no_links(many_partitions):
    assert components(many_partitions.createDataFrame([], "a long, b long")).count() == 0
    assert components(many_partitions.createDataFrame([(3, 3)], "a long, b long")).count() == 0
