"""Accuracy and follow-up results against published figures."""

from __future__ import annotations

import pytest

from landtrace import class_table
from landtrace.operators.aggregates import quantile_bands
from landtrace.plans.summaries import followup_crosstab
from landtrace.plans.validation import validation_metrics

# How often each difference (observed minus estimated) was found, by measure.
DIFFERENCES = {
    "Deforestation": {
        -26: 1, -10: 1, -8: 1, -6: 1, -5: 1, -4: 1, -2: 4, -1: 15, 0: 57, 1: 5, 2: 2, 3: 3, 4: 1, 6: 3, 16: 1,
    },
    "Agriculture Establishment": {
        -20: 1, -14: 1, -11: 1, -10: 2, -8: 2, -7: 1, -6: 3, -5: 1, -4: 2, -3: 5, -2: 5, -1: 10, 0: 12, 1: 9, 2: 8,
        3: 7, 4: 8, 5: 2, 6: 1, 7: 4, 8: 2, 9: 1, 10: 1, 13: 1, 15: 1, 17: 1, 20: 1, 23: 1,
    },
    "Conversion Length": {
        -20: 1, -16: 1, -14: 1, -13: 1, -11: 1, -10: 2, -8: 2, -7: 3, -6: 3, -5: 1, -4: 1, -3: 3, -2: 6, -1: 5, 0: 9,
        1: 9, 2: 8, 3: 10, 4: 6, 5: 3, 6: 2, 7: 4, 8: 2, 10: 2, 12: 1, 13: 1, 15: 1, 18: 1, 20: 1, 23: 1, 25: 1,
    },
}
# Sums of what was observed, in absolute years or years of length.
OBSERVED = {"Deforestation": 1513 + 97 * 1984, "Agriculture Establishment": 2415 + 94 * 1984, "Conversion Length": 970}
# Mean absolute error, bias and percent bias of each measure.
METRICS = {
    "Deforestation": (1.422680412371134, -0.26804123711340205, -0.013404756626332098),
    "Agriculture Establishment": (4.24468085106383, 0.9680851063829787, 0.048170831767340175),
    "Conversion Length": (5.161290322580645, 1.2043010752688172, 11.54639175257732),
}
# Bounds of the outer and the inner envelope of each measure.
BANDS = {
    "Deforestation": [(-4.2, 3.2), (-1, 0)],
    "Agriculture Establishment": [(-8.7, 11.05), (-1.75, 3.75)],
    "Conversion Length": [(-10.4, 13.8), (-2, 4)],
}
# Cells by crop and by class five years after establishment.
FOLLOW_UP = [
    (41, 15, 7491622), (39, 41, 1211660), (41, 30, 5023), (39, 3, 24046), (39, 11, 94), (41, 25, 28), (41, 3, 486527),
    (41, 11, 23703), (39, 33, 409), (20, 41, 15301), (20, 39, 1917), (20, 9, 164), (41, 9, 57727), (20, 15, 33217),
    (39, 12, 272), (20, 11, 186), (41, 23, 51), (48, 4, 35), (39, 62, 305), (41, 4, 4586), (41, 33, 56575),
    (39, 39, 7072528), (48, 41, 14578), (41, 24, 25854), (48, 24, 60), (39, 4, 156), (41, 21, 42), (39, 15, 580879),
    (48, 15, 739295), (41, 20, 58185), (39, 20, 3286), (20, 20, 118961), (20, 12, 193), (39, 24, 936), (41, 62, 3028),
    (48, 3, 423145), (48, 39, 6736), (39, 48, 209), (41, 48, 14479), (48, 11, 141), (20, 3, 2163), (39, 30, 491),
    (48, 12, 327), (48, 30, 1621), (41, 41, 13511923), (41, 12, 6308), (41, 39, 27882470), (48, 48, 1590739),
    (41, 32, 321), (20, 4, 46), (41, 5, 438), (48, 9, 1008), (39, 9, 4212), (62, 39, 26), (48, 33, 21), (39, 21, 15),
    (20, 33, 4), (62, 41, 2), (39, 25, 2),
]


@pytest.fixture(scope="module")
def comparison(spark):
    rows = []
    for var, counts in DIFFERENCES.items():
        found = [d for d, n in counts.items() for _ in range(n)]
        seen = [OBSERVED[var] if k == 0 else 0 for k in range(len(found))]
        rows += [(var, d, o, o - d) for d, o in zip(found, seen)]
    return spark.createDataFrame(rows, "var string, difference int, observed int, estimated int")


def test_metrics(comparison):
    got = {r["var"]: (r["mae"], r["bias"], r["pbias"]) for r in validation_metrics(comparison).collect()}
    assert set(got) == set(METRICS)
    for var, want in METRICS.items():
        assert got[var] == pytest.approx(want, rel=1e-12)


def test_quantile_bands(comparison):
    got = {(r["var"], r["group_id"]): (r["min"], r["max"]) for r in quantile_bands(comparison, ["var"], "difference").collect()}
    assert len(got) == 6
    for var, groups in BANDS.items():
        for k, want in enumerate(groups, 1):
            assert got[var, k] == pytest.approx(want, abs=1e-9)


def test_followup_shares(spark):
    counts = spark.createDataFrame(FOLLOW_UP, "agri_code int, class_code int, count bigint")
    table = {r["agri_code"]: r for r in followup_crosstab(counts, class_table(spark)).collect()}
    assert table["Soybean"]["Soybean"] == pytest.approx(79.47, abs=0.005)
    shares = {k: r["total_perc"] for k, r in table.items()}
    assert shares["Other Temporary Crops"] == pytest.approx(80.73, abs=0.005)
    assert shares["Soybean"] == pytest.approx(14.48, abs=0.005)
    assert shares["Other Perennial Crop"] == pytest.approx(4.52, abs=0.005)
    assert shares["Sugar Cane"] == pytest.approx(0.28, abs=0.005)
