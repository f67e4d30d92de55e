"""Mergeable states against a full run, stored tables without an exchange."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from landtrace import ConversionSpec
from landtrace.operators.refresh import merge_states, state_cycles, summarize
from landtrace.plans import stored, summaries
from landtrace.plans.conversion import conversion_classes, conversion_cycles
from landtrace.sources.scratch import scratch_path
from suite.tables import Tables

SPEC = ConversionSpec()


def series(seed, cells=150, years=range(1985, 2005)):
    rng = random.Random(seed)
    rows = []
    for c in range(cells):
        for y in years:
            if rng.random() < 0.85:
                rows.append((c, y, rng.choice([3, 3, 15, 39, 48, 33, 21, 0 if c % 7 else 41])))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("cuts", [[1986, 1990, 2003], list(range(1987, 2004, 3))])
def test_states_of_stretches_equal_a_full_run(spark, cuts):
    panel = spark.createDataFrame(series(1), "cell_id long, year int, class_code int").cache()
    ends = [0, *cuts, 9999]
    parts = [summarize(panel.filter((F.col("year") >= a) & (F.col("year") < b)), SPEC) for a, b in zip(ends, ends[1:])]
    random.Random(2).shuffle(parts)
    want = rows_of(conversion_cycles(panel, SPEC))
    assert rows_of(state_cycles(merge_states(parts))) == want and want
    if len(parts) == 4:  # any grouping
        parts = [summarize(panel.filter((F.col("year") >= a) & (F.col("year") < b)), SPEC) for a, b in zip(ends, ends[1:])]
        left = merge_states([merge_states([merge_states(parts[:2]), parts[2]]), parts[3]])
        right = merge_states([parts[0], merge_states([parts[1], merge_states(parts[2:])])])
        assert rows_of(left) == rows_of(right) == rows_of(summarize(panel, SPEC))


def test_overlap_is_an_error(spark):
    panel = spark.createDataFrame(series(3, 5), "cell_id long, year int, class_code int")
    state = summarize(panel, SPEC)
    with pytest.raises(Exception, match="overlap"):
        merge_states([state, state]).collect()


@pytest.mark.parametrize("seed", [4])
def test_refresh_year_by_year(spark, seed):
    panel = spark.createDataFrame(series(seed, 80), "cell_id long, year int, class_code int").cache()
    root = scratch_path(spark, "refresh")
    stored.start_state(panel.filter("year < 2001"), SPEC, root)
    for version, year in enumerate(range(2001, 2005), 1):
        cycles, classes = stored.add_years(panel.filter(F.col("year") == year), SPEC, root, version)
        # a version that is run again, as after a lost driver, changes nothing
        if version == 2:
            cycles, classes = stored.add_years(panel.filter(F.col("year") == year), SPEC, root, version)
    assert rows_of(cycles) == rows_of(conversion_cycles(panel, SPEC))
    assert rows_of(classes) == rows_of(conversion_classes(panel, SPEC))


def exchanges_below_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    below = plan[plan.index("SortMergeJoin"):]
    return below.count("Exchange")


def test_joins_of_bucketed_tables_move_nothing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    root, prefix = scratch_path(spark, "buckets"), f"t{uuid.uuid4().hex}"
    names = [stored.LENGTH, stored.CLASSES, stored.MASK]
    stored.store_by_cell(dict(zip(names, (t.c_length, t.c_classes, t.mask))), root, prefix, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fresh in (False, True):
            if fresh:  # a session that knows the files only
                for n in names:
                    spark.sql(f"drop table {prefix}_{n}")
            length, classes, mask = stored.open_by_cell(spark, names, root, prefix, buckets=4)
            assert exchanges_below_join(stored.stored_followup_counts(length, classes)) == 0
            assert exchanges_below_join(summaries.area_by_year(length, mask)) == 0
            counts = stored.stored_followup_counts(length, classes)
            assert rows_of(counts) == rows_of(summaries.followup_counts(t.c_length, t.c_classes))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
