"""Spatial operators against brute force on random layers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from landtrace.functions.geometry import pixel_area
from landtrace.operators.hexgrid import hex_bin, hex_centre
from landtrace.operators.polygons import nearest_polygon, points_inside, polygons_touching, within_distance

EDGE_SCHEMA = "poly_id int, ring int, x1 double, y1 double, x2 double, y2 double"


def star(rng, poly, cx, cy, ring=0, size=1.0):
    """A simple, usually concave polygon around a centre."""
    n = rng.randint(5, 12)
    pts = []
    for i in range(n):
        r = size * rng.uniform(0.3, 1.4)
        pts.append((cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)))
    return [(poly, ring, *pts[i], *pts[(i + 1) % n]) for i in range(n)]


def holds(edges, x, y):
    return sum(
        (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x for _, _, x1, y1, x2, y2 in edges
    ) % 2 == 1


def distance(edges, x, y):
    best = math.inf
    for _, _, x1, y1, x2, y2 in edges:
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.fixture(scope="module")
def layer():
    rng = random.Random(11)
    polys = {}
    for i in range(14):
        cx, cy = rng.uniform(-8, 8), rng.uniform(-8, 8)
        polys[i] = star(rng, i, cx, cy)
        if i % 3 == 0:
            polys[i] += star(rng, i, cx, cy, ring=1, size=0.15)
    return polys


@pytest.fixture(scope="module")
def points():
    rng = random.Random(12)
    return [(i, rng.uniform(-30, 30) if i % 4 == 0 else rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(1500)]


def frames(spark, layer, points):
    edges = spark.createDataFrame([e for p in layer.values() for e in p], EDGE_SCHEMA)
    return edges, spark.createDataFrame(points, "id int, x double, y double")


@pytest.mark.parametrize("bucket", [0.3, 2.0])
def test_inside_and_nearest(spark, layer, points, bucket):
    edges, pts = frames(spark, layer, points)
    inside = {(r.id, r.poly_id) for r in points_inside(pts, edges, bucket).collect()}
    assert inside == {(i, p) for i, x, y in points for p, e in layer.items() if holds(e, x, y)}
    near = {r.id: (r.poly_id, r.distance) for r in nearest_polygon(pts, edges, bucket).collect()}
    assert len(near) == len(points)
    for i, x, y in points:
        ranked = sorted((0.0 if holds(e, x, y) else distance(e, x, y), p) for p, e in layer.items())
        assert near[i][0] == ranked[0][1] and near[i][1] == pytest.approx(ranked[0][0], abs=1e-9)


def test_axis_aligned_squares_on_cell_centres(spark):
    """Corners and edges on the very points the index computes with."""
    squares = {
        0: [(0, 0, 0.5, 0.5, 2.5, 0.5), (0, 0, 2.5, 0.5, 2.5, 2.5), (0, 0, 2.5, 2.5, 0.5, 2.5), (0, 0, 0.5, 2.5, 0.5, 0.5)],
        1: [(1, 0, 2.5, 0.5, 4.5, 0.5), (1, 0, 4.5, 0.5, 4.5, 2.5), (1, 0, 4.5, 2.5, 2.5, 2.5), (1, 0, 2.5, 2.5, 2.5, 0.5)],
    }
    grid = [(i * 20 + j, i / 4, j / 4) for i in range(20) for j in range(14)]
    edges, pts = frames(spark, squares, grid)
    inside = {(r.id, r.poly_id) for r in points_inside(pts, edges, 1.0).collect()}
    assert inside == {(i, p) for i, x, y in grid for p, e in squares.items() if holds(e, x, y)}


def test_layer_outside_extent_is_an_error(spark, layer, points):
    edges, pts = frames(spark, layer, points)
    with pytest.raises(Exception, match="outside extent"):
        nearest_polygon(pts, edges, 1.0, extent=0.5).collect()


def test_missing_coordinates_have_no_polygon(spark, layer):
    edges, pts = frames(spark, layer, [(1, None, 2.0), (2, 1.0, None), (3, 0.0, 0.0)])
    near = {r.id: r.poly_id for r in nearest_polygon(pts, edges, 1.0).collect()}
    assert near[1] is None and near[2] is None and near[3] is not None


def test_touching(spark, layer):
    edges, _ = frames(spark, layer, [(0, 0.0, 0.0)])
    rng = random.Random(5)
    other = {100 + i: star(rng, 100 + i, rng.uniform(-8, 8), rng.uniform(-8, 8), size=0.4) for i in range(20)}
    others = spark.createDataFrame([e for p in other.values() for e in p], EDGE_SCHEMA)

    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def meet(e, f):
        a, b, c, d = e[2:4], e[4:6], f[2:4], f[4:6]
        return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0

    expected = {
        (p, q) for p, es in layer.items() for q, fs in other.items()
        if any(meet(e, f) for e in es for f in fs) or holds(fs, *es[0][2:4]) or holds(es, *fs[0][2:4])
    }
    assert {tuple(r) for r in polygons_touching(edges, others, 0.7).collect()} == expected and expected


def test_within_distance(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-60, -59), rng.choice([-12.5, 0.0, 70.0, 89.5]) + rng.uniform(-0.2, 0.2)) for i in range(600)]
    centres = [(1000 + i, x, y) for i, x, y in pts[::37]]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    near = within_distance(df, spark.createDataFrame(centres, "sample int, x double, y double"), 12_000.0)

    def far(x1, y1, x2, y2):
        a = (math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2))
             * math.sin(math.radians(x2 - x1) / 2) ** 2)
        return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(a)))

    expected = {(i, s) for i, x, y in pts for s, cx, cy in centres if far(cx, cy, x, y) <= 12_000}
    assert {(r.id, r["sample"]) for r in near.collect()} == expected and len(expected) > len(centres)


def test_within_distance_across_the_date_line(spark):
    pts = [(1, -179.9995, 0.0), (2, 179.9995, 0.0), (3, 179.98, 0.0), (4, 0.0, 0.0), (5, -180.0, 0.001)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    centres = spark.createDataFrame([(10, 179.9995, 0.0), (11, -179.9995, 0.0)], "sample int, x double, y double")
    near = sorted((r.id, r["sample"]) for r in within_distance(df, centres, 1000.0).collect())
    assert near == [(1, 10), (1, 11), (2, 10), (2, 11), (5, 10), (5, 11)]


def test_nearest_plan_grows_by_a_constant(spark):
    """Finer cells add levels; each adds as many exchanges as the one before."""
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0)], EDGE_SCHEMA)
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    plans = [nearest_polygon(points, edges, bucket)._jdf.queryExecution().executedPlan().toString()
             for bucket in (1.0, 0.1, 0.01, 0.001)]
    exchanges = [p.count("Exchange") for p in plans]
    steps = [b - a for a, b in zip(exchanges, exchanges[1:])]
    assert max(steps) <= 20 and max(steps) - min(s for s in steps if s) <= 6, exchanges


def test_nearest_with_most_points_in_one_cell(spark):
    rng = random.Random(6)
    edges = [e for k in range(4) for e in star(rng, k, 3 * k, 0)]
    pts = [(i, 5.2 + rng.uniform(0, 0.2), 1.3 + rng.uniform(0, 0.2)) for i in range(3000)] + [(3000, -170.0, 80.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    layer = spark.createDataFrame(edges, EDGE_SCHEMA)
    by_poly = {k: [e for e in edges if e[0] == k] for k in range(4)}
    for r in nearest_polygon(df, layer, 0.5).collect():
        if any(holds(es, r.x, r.y) for es in by_poly.values()):
            assert r.distance == 0
        else:
            best = min((distance(es, r.x, r.y), k) for k, es in by_poly.items())
            assert r.poly_id == best[1] and abs(r.distance - best[0]) < 1e-9


def test_hexagon_is_the_nearest_centre(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(2000)], "x double, y double")
    binned = hex_bin(df, "x", "y", 0.7)
    cx, cy = hex_centre(F.col("hex_q"), F.col("hex_r"), 0.7)
    found = binned.withColumns({"cx": cx, "cy": cy}).collect()
    centres = {(r.cx, r.cy) for r in found}
    for r in found[:300]:
        assert math.hypot(r.x - r.cx, r.y - r.cy) <= min(math.hypot(r.x - a, r.y - b) for a, b in centres) + 1e-9


def test_pixel_areas_add_up_to_the_ellipsoid(spark):
    lats = spark.range(1800).select((F.col("id") / 10 - 90 + 0.05).alias("lat"))
    total = lats.agg(F.sum(pixel_area(F.col("lat"), 0.1))).first()[0] * 3600
    assert total == pytest.approx(5.10065621724e14, rel=1e-9)
