"""The registered queries against their SQL, their plans, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from compare import difference
from fixtures import pairs
from landtrace.llm.queries import QUERIES, SQL
from test_nearcopies import groups

NATIVE = ["op1_line_dedup", "op5_benchmark_decontamination", "op7_license_scan", "op9_kd_shards", "op10_host_quality"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, con, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages[names[0]](spark, docs, sf_dir).cache()
    verdict = {r["doc_id"] for r in QUERIES["op10_host_quality"](spark, sf_dir).filter("kept").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == verdict

    cut = stages[names[1]](spark, kept, sf_dir).cache()
    assert cut.columns == columns and cut.count() == kept.count()

    single = stages[names[2]](spark, cut, sf_dir).cache()
    firsts = [min(i for i, _ in g) for g in groups(pairs(cut))]
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(firsts)

    clean = stages[names[3]](spark, single, sf_dir).cache()
    assert clean.columns == columns and 0 < clean.count() < single.count()
    packed = stages[names[4]](spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))
