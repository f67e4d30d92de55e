"""Cycles on hand-written and random series, against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from landtrace import ConversionSpec
from landtrace.operators.cycles import band_join
from landtrace.operators.panel import bands_to_rows, rows_to_bands
from landtrace.plans.conversion import (
    conversion_classes, conversion_cycles, select_candidate_cells, wide_conversion_classes, wide_conversion_cycles,
)
from landtrace.plans.summaries import followup_counts

SPEC = ConversionSpec()
COLUMNS = ["agri_code", "forest_year", "agri_year", "c_length", "c_cycle", "forest_type", "agri_cycle"]


def series(*runs):
    """(first year, last year, class) runs as {year: class}."""
    return {y: c for a, b, c in runs for y in range(a, b + 1)}


CASES = {
    "two cycles": (
        series((1985, 1986, 3), (1987, 1987, 15), (1988, 1989, 39), (1990, 1990, 3), (1991, 1991, 39), (1992, 1998, 15)),
        [(39, 1987, 1988, 1, 1, 1, 1), (39, 1991, 1991, 0, 2, 2, 2)],
    ),
    "direct": (series((1985, 1990, 3), (1991, 1995, 41)), [(41, 1991, 1991, 0, 1, 1, 1)]),
    "never forest": (series((1985, 1990, 15), (1991, 1995, 39)), []),
    "never agriculture": (series((1985, 1990, 3), (1991, 1995, 15)), []),
    "agriculture before forest": (
        series((1985, 1987, 39), (1988, 1990, 3), (1991, 1992, 39)), [(39, 1991, 1991, 0, 2, 2, 1)],
    ),
    "agriculture before forest only": (series((1985, 1987, 39), (1988, 1990, 3)), []),
    "mosaic between": (
        series((1985, 1987, 3), (1988, 1990, 25), (1991, 1992, 3), (1993, 1994, 20)), [(20, 1993, 1993, 0, 1, 1, 1)],
    ),
    "mosaic carries the mark": (
        series((1985, 1985, 3), (1986, 1986, 15), (1987, 1987, 25), (1988, 1988, 3), (1989, 1989, 62)),
        [(62, 1989, 1989, 0, 2, 2, 1)],
    ),
    "missing years": (
        series((1985, 1986, 3), (1990, 1990, 15), (1995, 1995, 48)), [(48, 1987, 1995, 8, 1, 1, 1)],
    ),
    "agriculture in the last year": (series((1985, 2020, 3), (2021, 2021, 46)), [(46, 2021, 2021, 0, 1, 1, 1)]),
    "first crop counts": (
        series((1985, 1985, 3), (1986, 1986, 15), (1987, 1987, 41), (1988, 1990, 39)), [(41, 1986, 1987, 1, 1, 1, 1)],
    ),
    "unknown class": (series((1985, 1985, 3), (1986, 1986, 99), (1987, 1987, 39)), [(39, 1986, 1987, 1, 1, 1, 1)]),
}


def panel_of(spark, cells):
    rows = [(i, y, c) for i, s in cells.items() for y, c in s.items()]
    return spark.createDataFrame(rows, "cell_id bigint, year int, class_code int")


def found(df, cell=None):
    df = df if cell is None else df.filter(F.col("cell_id") == cell)
    return sorted(tuple(r[c] for c in ("cell_id", *COLUMNS)) for r in df.collect())


def by_loop(cells, spec=SPEC):
    """Cycle after cycle over the years that remain, as a person would do it."""
    lengths, classes = [], []
    for cell, years in cells.items():
        left, cycle, agri_cycle = dict(sorted(years.items())), 0, 0
        while left:
            cycle += 1
            human = [y for y, c in left.items() if c in spec.anthropic]
            again = [y for y, c in left.items() if human and c in spec.natural and y > human[0]]
            now = {y: c for y, c in left.items() if not again or y < again[0]}
            natural = [y for y, c in now.items() if c in spec.natural]
            agri = [y for y, c in now.items() if c in spec.agriculture]
            if natural and agri:
                agri_cycle += 1
                gone, sown = natural[-1] + 1, agri[0]
                lengths.append((cell, now[sown], gone, sown, sown - gone, cycle, 1 if cycle == 1 else 2, agri_cycle))
                classes += [
                    (cell, agri_cycle, y, c) for y, c in left.items() if gone < y <= sown + spec.after
                ]
            left = {y: c for y, c in left.items() if again and y >= again[0]}
    return sorted(lengths), sorted(classes)


@pytest.fixture(scope="module")
def named(spark):
    cells = {i: s for i, (s, _) in enumerate(CASES.values())}
    panel = panel_of(spark, cells)
    return conversion_cycles(panel, SPEC).collect(), panel


@pytest.mark.parametrize("number,name", list(enumerate(CASES)))
def test_named_series(named, number, name):
    rows = sorted(tuple(r[c] for c in COLUMNS) for r in named[0] if r.cell_id == number)
    assert rows == CASES[name][1]
    assert [r[1:] for r in by_loop({number: CASES[name][0]})[0]] == CASES[name][1]


@pytest.fixture(scope="module")
def random_cells():
    rng = random.Random(7)
    codes = [3, 3, 3, 15, 15, 39, 41, 25, 33, 24]
    return {
        i: {y: rng.choice(codes) for y in range(1985, 2022) if rng.random() > 0.1} for i in range(300)
    }


def test_random_series_agree_in_every_form(spark, random_cells):
    lengths, classes = by_loop(random_cells)
    panel = panel_of(spark, random_cells)
    wide = rows_to_bands(panel, range(1985, 2022), ["cell_id"])
    cycles = conversion_cycles(panel, SPEC)
    assert found(cycles) == lengths
    assert found(wide_conversion_cycles(wide, SPEC)) == lengths
    for df in (conversion_classes(panel, SPEC), wide_conversion_classes(wide, SPEC), band_join(panel, cycles, 5)):
        assert sorted(tuple(r) for r in df.select("cell_id", "agri_cycle", "year", "class_code").collect()) == classes


def test_classes_repeat_years_of_overlapping_cycles(spark):
    panel = panel_of(spark, {0: CASES["two cycles"][0]})
    years = {}
    for r in conversion_classes(panel, SPEC).collect():
        years.setdefault(r.agri_cycle, []).append(r.year)
    assert sorted(years[1]) == list(range(1988, 1994)) and sorted(years[2]) == list(range(1992, 1997))


def test_natural_class_that_is_also_anthropic(spark, random_cells):
    spec = ConversionSpec(natural=(3, 24), agriculture=(39, 41, 24))
    lengths, _ = by_loop(random_cells, spec)
    panel = panel_of(spark, random_cells)
    wide = rows_to_bands(panel, range(1985, 2022), ["cell_id"])
    assert found(conversion_cycles(panel, spec)) == found(wide_conversion_cycles(wide, spec)) == lengths


def test_wide_round_trip_and_candidates(spark, random_cells):
    panel = panel_of(spark, random_cells)
    wide = rows_to_bands(panel, range(1985, 2022), ["cell_id"])
    back = bands_to_rows(wide, ["cell_id"])
    assert back.exceptAll(panel).count() == 0 and panel.exceptAll(back).count() == 0
    kept = {r.cell_id for r in select_candidate_cells(wide, SPEC).collect()}
    assert kept == {
        i for i, s in random_cells.items() if 3 in s.values() and {39, 41} & set(s.values())
    }


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffles(spark, tmp_path, random_cells):
    panel_of(spark, random_cells).write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    rows_to_bands(panel, range(1985, 2022), ["cell_id"]).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    assert exchanges(conversion_cycles(panel, SPEC)) == 1
    assert exchanges(conversion_classes(panel, SPEC)) <= 2
    assert exchanges(wide_conversion_cycles(wide, SPEC)) == 0
    assert exchanges(wide_conversion_classes(wide, SPEC)) == 0


def test_followup_shares_of_first_cycles(spark, random_cells):
    lengths, classes = by_loop(random_cells)
    first = {r[0]: r for r in lengths if r[7] == 1}
    expected = {}
    for cell, cycle, year, code in classes:
        if cycle == 1 and year - first[cell][3] == 5:
            expected[(first[cell][1], code)] = expected.get((first[cell][1], code), 0) + 1
    panel = panel_of(spark, random_cells)
    counts = followup_counts(conversion_cycles(panel, SPEC), conversion_classes(panel, SPEC))
    assert {(r.agri_code, r.class_code): r["count"] for r in counts.collect()} == expected
