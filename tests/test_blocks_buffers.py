"""Block rasters, buffers, exact quantiles and large samples against plain code."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landtrace.operators.aggregates import exact_quantiles
from landtrace.operators.blocks import block_mosaic, block_raster, mosaic_cells, raster_cells
from landtrace.operators.buffers import boxes_meeting, buffer_rings, scan_spans, union_spans
from landtrace.operators.overlay import ring_edges
from landtrace.operators.sampling import sample_many, sample_n
from landtrace.operators.tiles import mosaic, rasterize

BANDS = ("agri_code", "c_length")


@pytest.fixture(scope="module")
def raster(spark):
    """Two tiles of 30 x 20 cells with sparse values, runs of equal ones and NULLs; the tiles overlap by 5 columns."""
    rng = random.Random(4)
    cells, mask, n = [], [], 0
    for tile in (1, 2):
        for cell in range(1, 601):
            n += 1
            mask.append((n, tile, cell))
            for cycle in (1, 2) if tile == 1 else (1,):
                if rng.random() < 0.5:
                    cells.append((n, cycle, None if cell % 11 == 0 else 39, 7 if cell < 200 else rng.randrange(4)))
    meta = [(1, 20, 30), (2, 20, 30)]
    offsets = [(1, 0, 0, 1), (2, 3, 25, 2)]
    frames = (
        spark.createDataFrame(cells, "cell_id int, agri_cycle int, agri_code int, c_length int"),
        spark.createDataFrame(mask, "cell_id int, tile_id int, tile_cell_id int"),
        spark.createDataFrame(meta, "tile_id int, n_row int, n_col int"),
        spark.createDataFrame(offsets, "tile_id int, row_offset int, col_offset int, tile_order int"))
    return [f.cache() for f in frames]


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("side", [4, 16, 256])
def test_blocks_unpack_to_the_grid(raster, side):
    cells, mask, meta, offsets = raster
    stored = block_raster(cells, mask, meta, BANDS, side)
    assert rows_of(raster_cells(stored, meta, BANDS, side)) == rows_of(rasterize(cells, mask, meta, BANDS))
    whole = block_mosaic(cells, mask, meta, offsets, BANDS, side)
    assert rows_of(mosaic_cells(whole, BANDS, side)) == rows_of(mosaic(cells, mask, meta, offsets, BANDS))


def test_runs_are_compressed_and_bounded(spark):
    """A row holds one block: 200 of them for a raster 50 times as wide, and a constant block is a single run."""
    cells = spark.range(1, 16 * 3200 + 1).select(
        F.col("id").alias("cell_id"), F.lit(1).alias("agri_cycle"), F.lit(39).alias("agri_code"), F.col("id").cast("int").alias("c_length"))
    mask = cells.select("cell_id", F.lit(1).alias("tile_id"), F.col("cell_id").cast("int").alias("tile_cell_id"))
    meta = spark.createDataFrame([(1, 16, 3200)], "tile_id int, n_row int, n_col int")
    blocks = block_raster(cells, mask, meta, BANDS, 16)
    sizes = blocks.agg(F.count("*"), F.max(F.size("agri_code")), F.max(F.size("c_length"))).first()
    assert tuple(sizes) == (200, 1, 256)


def great_circle(x1, y1, x2, y2):
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(
        math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(a))


def test_circles_lie_at_their_radius(spark):
    points = spark.createDataFrame([(1, 10.0, 75.0), (2, 179.9, -60.0), (3, -50.0, 0.0)], "id int, x double, y double")
    centres = {r.id: (r.x, r.y) for r in points.collect()}
    for r in buffer_rings(points, "id", 50_000.0).collect():
        assert len(r.points) == 64
        assert all(great_circle(*centres[r.poly_id], p.x, p.y) == pytest.approx(50_000.0, rel=1e-9) for p in r.points)
        assert max(p.x for p in r.points) - min(p.x for p in r.points) < 10


def test_union_against_a_fine_grid(spark):
    rng = random.Random(6)
    centres = [(i, rng.uniform(0, 2), rng.uniform(0, 2)) for i in range(12)]
    rings = buffer_rings(spark.createDataFrame(centres, "id int, x double, y double"), "id", 40_000.0, corners=128)
    step = 0.01
    spans = union_spans(scan_spans(ring_edges(rings), step)).collect()
    area = sum(s.xb - s.xa for s in spans) * step
    fine = sum(any(great_circle(x, y, cx, cy) <= 40_000 for _, cx, cy in centres)
               for x in np.arange(-1, 3, 0.02) for y in np.arange(-1, 3, 0.02)) * 0.02 * 0.02
    assert area == pytest.approx(fine, rel=0.01)
    by_line = {}
    for s in sorted(spans, key=lambda s: (s.line, s.xa)):
        assert s.xa < s.xb and by_line.get(s.line, -9) < s.xa
        by_line[s.line] = s.xb


@pytest.mark.parametrize("bucket", [0.3, 5.0])
def test_boxes(spark, bucket):
    rng = random.Random(7)

    def boxes(n, most):
        found = []
        for i in range(n):
            x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
            found.append((i, x, x + rng.uniform(0, most), y, y + rng.uniform(0, most)))
        return found + [(n, None, 1.0, 0.0, 1.0), (n + 1, 2.0, 1.0, 0.0, 1.0)]

    a, b = boxes(60, 1.0), boxes(80, 3.0)
    schema = "{} int, x_min double, x_max double, y_min double, y_max double"
    got = boxes_meeting(spark.createDataFrame(a, schema.format("i")), spark.createDataFrame(b, schema.format("j")), bucket)
    rows = [(r.i, r.j) for r in got.collect()]
    want = {(p[0], q[0]) for p in a[:-2] for q in b[:-2] if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("bins", [16, 1024])
def test_exact_quantiles(spark, bins):
    rng = random.Random(8)
    groups = {
        "even": [rng.uniform(-3, 9) for _ in range(999)], "far": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "near": [1 + k * 2.0**-52 for k in range(50)], "same": [4.5] * 30, "one": [7.0], None: [float(k % 5) for k in range(101)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    rng.shuffle(rows)
    probs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    found = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs, bins).collect()
    assert {r.g for r in found} == set(groups)
    for r in found:
        ordered = sorted(groups[r.g])
        for p, q in zip(probs, r.quantiles):
            place = (len(ordered) - 1) * p
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert q == pytest.approx(low + (high - low) * (place - math.floor(place)), rel=1e-15)


@pytest.mark.parametrize("few", [10_000, 3])
def test_many_sampled(spark, few):
    rows = spark.range(3000).select(F.col("id").alias("cell_id"), (F.col("id") % 7).alias("v"))
    for n in (0, 100, 1500, 5000):
        assert rows_of(sample_many(rows, "cell_id", n, 123, few)) == rows_of(sample_n(rows, "cell_id", n, 123))
    assert sample_many(rows.limit(0), "cell_id", 5, 1, few).count() == 0
    plan = sample_many(rows, "cell_id", 1500, 123)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan
