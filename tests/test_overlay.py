"""Clipped shapes against scan lines and shoelace areas."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from landtrace.operators.hexgrid import hex_bin
from landtrace.operators.overlay import (
    clip_to_hexagons, clip_to_tiles, clipped_areas, halved, mark_holes, ring_edges, signed_area)
from test_polygons import holds, star

RING = "poly_id int, ring int, points array<struct<x:double,y:double>>"


def corners(edges):
    return [(e[2], e[3]) for e in edges]


def shoelace(points):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1])) / 2


@pytest.fixture(scope="module")
def polys():
    rng = random.Random(31)
    found = []
    for i in range(9):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        outer, hole = corners(star(rng, i, cx, cy)), corners(star(rng, i, cx, cy, size=0.15))
        found.append((i, 0, outer if i % 2 else outer[::-1]))
        if i % 3 == 0:
            found.append((i, 1, hole))
            found.append((i, 2, [(cx + 0.01, cy), (cx, cy + 0.01), (cx - 0.01, cy)]))  # an island in the hole
    return found


def test_holes_and_areas(spark, polys):
    rings = spark.createDataFrame(polys, RING)
    marked = {(r.poly_id, r.ring): r.hole for r in mark_holes(rings, 0.5).collect()}
    assert marked == {(p, k): k == 1 for p, k, _ in polys}
    areas = {(r.poly_id, r.ring): r.a for r in rings.select("poly_id", "ring", signed_area(F.col("points")).alias("a")).collect()}
    assert all(areas[p, k] == pytest.approx(shoelace(c)) for p, k, c in polys)
    assert ring_edges(rings).count() == sum(len(c) for _, _, c in polys)


@pytest.mark.parametrize("most", [256, 4])
def test_parts_add_up(spark, polys, most):
    rings = mark_holes(spark.createDataFrame(polys, RING))
    want = {}
    for p, k, c in polys:
        want[p] = want.get(p, 0) + (-1 if k == 1 else 1) * abs(shoelace(c))
    for parts, cell in (
            (clip_to_hexagons(rings, 0.37, (0.11, 0.05), most), ["hex_q", "hex_r"]), (clip_to_tiles(rings, 0.41, (0.2, 0.1), most), ["tile_x", "tile_y"])):
        areas = clipped_areas(parts, cell).groupBy("poly_id").agg(F.sum("area").alias("a")).collect()
        assert {r.poly_id: r.a for r in areas} == pytest.approx(want, abs=1e-9)


def test_each_hexagon_against_a_fine_grid(spark, polys):
    """The share of fine points of a hexagon that lie in the polygon."""
    size, step = 0.5, 0.01
    rings = mark_holes(spark.createDataFrame(polys, RING))
    areas = {(r.hex_q, r.hex_r, r.poly_id): r.area for r in clipped_areas(clip_to_hexagons(rings, size), ["hex_q", "hex_r"]).collect()}
    fine = [(i * step + 0.003, j * step + 0.004) for i in range(-200, 200) for j in range(-200, 200)]
    binned = hex_bin(spark.createDataFrame(fine, "x double, y double"), "x", "y", size).collect()
    chosen, counted = 3, {}
    edges = [(p, k, *c[i], *c[(i + 1) % len(c)]) for p, k, c in polys if p == chosen for i in range(len(c))]
    for r in binned:
        if holds(edges, r.x, r.y):
            counted[r.hex_q, r.hex_r] = counted.get((r.hex_q, r.hex_r), 0) + step * step
    seen = {k[:2] for k in areas if k[2] == chosen}
    for key, a in counted.items():
        if abs(key[0] + key[1] / 2) * size < 1.4 and abs(key[1]) * size < 1.4:
            assert areas[(*key, chosen)] == pytest.approx(a, abs=0.02)
    assert seen >= {k for k, a in counted.items() if a > 0.001}


def test_big_rings_are_halved(spark):
    rng = random.Random(5)
    n = 5000
    ring = [((2 + rng.uniform(-0.2, 0.2)) * math.cos(2 * math.pi * i / n), (2 + rng.uniform(-0.2, 0.2)) * math.sin(2 * math.pi * i / n))
            for i in range(n)]
    pieces = halved(spark.createDataFrame([(1, 0, ring), (2, 0, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], RING), 100).select(
        "poly_id", F.size("points").alias("n"), signed_area(F.col("points")).alias("a")).collect()
    assert max(r.n for r in pieces) <= 200 and sum(r.poly_id == 2 for r in pieces) == 1
    assert sum(r.a for r in pieces if r.poly_id == 1) == pytest.approx(shoelace(ring), abs=1e-9)


def test_odd_rings(spark):
    rows = [(1, 0, []), (2, 0, [(0.0, 0.0)]), (3, 0, [(0.0, 0.0), (1.0, 0.0)]), (4, 0, None), (5, 0, [(0.1, 0.1)] * 4)]
    rings = mark_holes(spark.createDataFrame(rows, RING))
    assert rings.count() == 5
    assert clipped_areas(clip_to_tiles(rings, 1.0), ["tile_x", "tile_y"]).count() == 0
    assert clipped_areas(clip_to_hexagons(rings.limit(0), 1.0), ["hex_q", "hex_r"]).count() == 0
