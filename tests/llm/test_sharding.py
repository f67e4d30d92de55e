from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from fixtures import documents, empty, sample
from landtrace.llm.sharding import _table, kd_shards, kd_tree


def check(docs, rows, shards):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["size"], r["text_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    slots, sizes, where = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    assert set(slots) <= set(range(shards))
    return sizes


def test_near_equal_bytes(spark, sf_dir):
    docs = sample(spark, sf_dir)
    rows = kd_shards(docs).collect()
    sizes = check(docs, rows, 8)
    largest = max(r["size"] for r in rows)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) <= 3 * largest for s in sizes.values())


def test_target_bytes_and_odd_rows(spark):
    docs = documents(spark)
    total = sum(r["size"] for r in kd_shards(docs).collect())
    for shards in (1, 3, 5):
        check(docs, kd_shards(docs, shards=shards).collect(), shards)
    check(docs, kd_shards(docs, target_bytes=total // 3).collect(), 4)
    assert kd_shards(empty(spark)).count() == 0


def cut(points, leaves, shard=0):
    """The same tree over a list of (g, w, a, b)."""
    if leaves == 1 or not points:
        return {p[0]: shard for p in points}
    spread = [max(p[d] for p in points) - min(p[d] for p in points) for d in (2, 3)]
    d = 2 + spread.index(max(spread))
    code = {p[0]: (round(p[d] * ((1 << 31) - 1)) << 32) + p[0] % (1 << 32) for p in points}
    points = sorted(points, key=lambda p: code[p[0]])
    lower = -(-leaves // 2)
    goal, below, k = sum(p[1] for p in points) * lower / leaves, 0, 0
    while k < len(points) and below + points[k][1] < goal:
        below += points[k][1]
        k += 1
    if k < len(points) and below + points[k][1] - goal < goal - below:
        k += 1
    return cut(points[:k], lower, shard) | cut(points[k:], leaves - lower, shard + lower)


def test_tree_against_recursion(spark):
    points = [(i * 7919 % 100_003, 1 + i * i % 97, (i % 10) / 10, (i * 37 % 1000) / 1000) for i in range(400)]
    groups = spark.createDataFrame(points, "g long, w long, a double, b double")
    for leaves in (2, 3, 8):
        got = {r["g"]: r["shard"] for r in kd_tree(groups, ["a", "b"], leaves).select("g", F.col("shard")).collect()}
        assert got == cut(points, leaves)


def test_node_tables_need_no_python_workers(spark):
    """Small tables of nodes are sent as Arrow, so nothing reads Python rows on the executors."""
    df = _table(spark, [(1, 2.5), (7, 0.5)], node=pa.int64(), goal=pa.float64())
    assert df.dtypes == [("node", "bigint"), ("goal", "double")] and sorted(map(tuple, df.collect())) == [(1, 2.5), (7, 0.5)]
    assert _table(spark, [], node=pa.int64()).count() == 0
    lineage = df._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" not in lineage and "SerDeUtil" not in lineage
