"""The spherical operators against plain three-dimensional arithmetic."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from landtrace.operators.sphere import arc_pieces, leaf_cells, nearest_on_sphere, unit_vector
from test_polygons import EDGE_SCHEMA, holds, star

RADIUS = 6371008.8


def vec(lon, lat):
    lam, phi = math.radians(lon), math.radians(lat)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def angle(a, b):
    c = cross(a, b)
    return math.atan2(math.sqrt(dot(c, c)), dot(a, b))


def to_arc(p, a, b):
    """Angle from p to the arc from a to b."""
    n = cross(a, b)
    size = math.sqrt(dot(n, n))
    ends = min(angle(p, a), angle(p, b))
    if size == 0:
        return ends
    if dot(cross(n, a), p) >= 0 and dot(cross(b, n), p) >= 0:
        return min(ends, abs(math.asin(max(-1.0, min(1.0, dot(n, p) / size)))))
    return ends


def layers(spark, polys, points):
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE_SCHEMA)
    return edges, spark.createDataFrame(points, "id int, x double, y double")


def check(spark, polys, points, inside=True, **options):
    edges, pts = layers(spark, polys, points)
    rows = nearest_on_sphere(pts, edges, **options).collect()
    assert len(rows) == len(points)
    arcs = [(p, vec(e[2], e[3]), vec(e[4], e[5])) for p, es in polys.items() for e in es]
    for r in rows:
        v = vec(r.x, r.y)
        ranked = sorted((to_arc(v, a, b) * RADIUS, p) for p, a, b in arcs)
        home = sorted(p for p, es in polys.items() if holds(es, r.x, r.y)) if inside else []
        if r.distance == 0 and home:
            assert r.poly_id == home[0]
            continue
        if home and ranked[0][0] < 200:  # between the arc and the straight line
            continue
        assert r.distance == pytest.approx(ranked[0][0], rel=1e-9, abs=1e-3)
        assert r.poly_id in {p for d, p in ranked if d <= ranked[0][0] + 1e-3}


def test_high_latitudes(spark):
    rng = random.Random(21)
    polys = {}
    for i in range(12):
        polys[i] = star(rng, i, rng.uniform(-40, 40), rng.uniform(60, 78), size=1.2)
    points = [(i, rng.uniform(-60, 60), rng.uniform(50, 80)) for i in range(400)]
    check(spark, polys, points, most_points=20, most_arcs=4)


def test_differs_from_plane_in_the_north(spark):
    """At 70 degrees a step in longitude is a third of one in latitude."""
    square = [(0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1)]
    polys = {
        k: [(k, 0, x + square[i][0], y + square[i][1], x + square[(i + 1) % 4][0], y + square[(i + 1) % 4][1]) for i in range(4)]
        for k, (x, y) in enumerate(((2.0, 70.0), (0.0, 71.0)))}
    edges, pts = layers(spark, polys, [(1, 0.0, 70.0)])
    assert nearest_on_sphere(pts, edges).first().poly_id == 0
    from landtrace.operators.polygons import nearest_polygon
    assert nearest_polygon(pts, edges).first().poly_id == 1


def test_date_line_and_pole(spark):
    polys = {
        1: [(1, 0, 179.5, 0.0, 179.9, 0.2), (1, 0, 179.9, 0.2, 179.6, 0.4), (1, 0, 179.6, 0.4, 179.5, 0.0)],
        2: [(2, 0, -150.0, 1.0, -149.0, 1.0), (2, 0, -149.0, 1.0, -149.5, 2.0), (2, 0, -149.5, 2.0, -150.0, 1.0)],
        3: [(3, 0, 10.0, 88.0, 12.0, 88.0), (3, 0, 12.0, 88.0, 11.0, 88.5), (3, 0, 11.0, 88.5, 10.0, 88.0)],
    }
    points = [(1, -179.9, 0.1), (2, -160.0, 0.0), (3, -170.0, 89.0), (4, 0.0, 90.0), (5, 100.0, -90.0), (6, -179.0, 85.0)]
    check(spark, polys, points, inside=False)


def test_long_arcs_are_cut(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 50.0, 90.0, 50.0), (1, 0, 3.0, 3.0, 3.0, 3.0)], EDGE_SCHEMA)
    rows = arc_pieces(edges, 1.0).collect()
    long = sorted((r for r in rows if r.x1 != r.x2), key=lambda r: r.x1)
    assert len(long) == math.ceil(math.degrees(angle(vec(0, 50), vec(90, 50)))) and len(rows) == len(long) + 1
    assert (long[0].x1, long[0].y1, long[-1].x2, long[-1].y2) == (0.0, 50.0, 90.0, 50.0)
    assert max(r.y2 for r in long) == pytest.approx(math.degrees(math.atan(math.tan(math.radians(50)) / math.cos(math.radians(45)))), abs=0.02)
    for a, b in zip(long, long[1:]):
        assert (a.x2, a.y2) == pytest.approx((b.x1, b.y1)) and 2 * math.asin(a.r) <= math.radians(1.0)


def test_leaves_stay_small_where_items_crowd(spark):
    """Most items in one small place, some of them in the very same point."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(10, 1e-4), rng.gauss(50, 1e-4)) for i in range(4000)] + [(5000 + i, -20.0, 10.0) for i in range(500)]
    rows += [(9000 + i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)]
    items = spark.createDataFrame(rows, "id int, lon double, lat double").withColumn("v", unit_vector(F.col("lon"), F.col("lat")))
    leaves = leaf_cells(items, "v", 50)
    assert leaves.count() == len(rows)
    assert leaves.groupBy("_leaf", "_part").count().agg(F.max("count")).first()[0] <= 100


def test_crowded_layer(spark):
    rng = random.Random(9)
    polys = {i: star(rng, i, rng.gauss(5, 0.01), rng.gauss(65, 0.005), size=0.002) for i in range(60)}
    polys[99] = star(rng, 99, -30, 40)
    points = [(i, rng.gauss(5, 0.02), rng.gauss(65, 0.01)) for i in range(300)] + [(1000 + i, rng.uniform(-180, 180), 20.0) for i in range(40)]
    check(spark, polys, points, most_points=16, most_arcs=4)


def test_odd_points_and_empty_layer(spark):
    polys = {0: star(random.Random(1), 0, 3.0, 3.0)}
    edges, pts = layers(spark, polys, [(1, None, 2.0), (2, 1.0, float("nan")), (3, 3.0, 3.0), (4, 50.0, 3.0), (4, 50.0, 3.0)])
    rows = {r.id: (r.poly_id, r.distance) for r in nearest_on_sphere(pts, edges).collect()}
    assert rows[1] == (None, None) and rows[2] == (None, None) and rows[3] == (0, 0.0) and rows[4][0] == 0
    none = nearest_on_sphere(pts, edges.limit(0)).collect()
    assert len(none) == 4 and all(r.poly_id is None for r in none)
