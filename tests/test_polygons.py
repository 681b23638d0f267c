"""Covers, points inside, cells met, inner points and covered area against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from obsweave.operators import areas as R
from obsweave.operators import grid as G
from obsweave.operators import polygons as P

RINGS = "array<array<struct<x:double,y:double>>>"
CELL = "cell_id string, sw_lon double, sw_lat double, step_lon double, step_lat double"


def real(rings):
    return None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]


def frame(spark, rows, key):
    return spark.createDataFrame([(k, real(r)) for k, r in rows], f"{key}, rings {RINGS}")


def star(rnd, x, y, size, n):
    """A ring that bends in and out around a point."""
    return [(x + size * rnd.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), y + size * rnd.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def inside(rings, px, py):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def shapes_of(seed):
    rnd = random.Random(seed)
    out = [(f"u{k}", [star(rnd, rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.choice([0.03, 0.2, 1.5]), rnd.choice([3, 5, 12, 40]))]) for k in range(12)]
    # a hole, two parts, a ring of two corners, and edges that lie on lattice lines
    out += [("hole", [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]),
            ("parts", [[(-1, -1), (-0.5, -1), (-0.5, -0.5)], [(0.3, -1), (1.1, -1), (0.3, -0.2)]]), ("thin", [[(0, 0), (1, 1)]]), ("none", [])]
    return rnd, out


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_polygons_equals_the_plain_rule(spark, seed):
    rnd, shapes = shapes_of(seed)
    pts = [(f"p{i}", rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(700)] + [("q1", 0.05, 0.0501), ("q2", 0.1, 0.25), ("q3", 1.0, 1.0)]
    got = P.points_in_polygons(spark.createDataFrame(pts, "cell_id string, lon double, lat double"), frame(spark, shapes, "admin_id string"))
    want = sorted((p, u) for p, x, y in pts for u, rings in shapes if len(rings) and inside([r for r in rings if len(r) > 2], x, y))
    assert sorted((r.cell_id, r.admin_id) for r in got.collect()) == want


def test_inner_points_lie_inside(spark):
    _, shapes = shapes_of(3)
    bow = ("bow", [[(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)]])
    df = frame(spark, [*shapes, bow], "admin_id string")
    got = {r.admin_id: (r.lon, r.lat) for r in P.inner_points(df).collect()}
    assert set(got) == {u for u, r in shapes if u not in ("thin", "none")} | {"bow"}
    for u, rings in [*shapes, bow]:
        if u in got:
            assert inside(rings, *got[u]), u
    # the centre of the bow's bounds lies outside it
    parent = frame(spark, [("left", [[(-1, -1), (1, -1), (1, 5), (-1, 5)]]), ("middle", [[(1, -1), (3, -1), (3, 5), (1, 5)]])], "admin_id string")
    assert [r.parent_id for r in G.derive_parents(df.where("admin_id = 'bow'"), parent).collect()] == ["left"]


def cells_of(spark, n=20, step=0.04):
    return spark.createDataFrame([(f"{i}:{j}", -0.4 + step * i, -0.4 + step * j, step, step) for i in range(n) for j in range(n)], CELL)


def test_cells_of_shapes(spark):
    rnd = random.Random(5)
    shapes = [("small", [[(0.011, 0.011), (0.012, 0.011), (0.012, 0.012)]], None), ("large", [star(rnd, 0, 0, 0.35, 9)], None), ("line", None, [(-1.0, -0.9), (0.31, 0.33), (0.31, 0.1)]),
              ("far", [[(5, 5), (6, 5), (6, 6)]], None), ("point", None, [(0.0, 0.0)])]
    df = spark.createDataFrame([(k, real(r), v) for k, r, v in shapes], f"aoi_id string, rings {RINGS}, vertices array<struct<x:double,y:double>>")
    got = {(r.aoi_id, r.cell_id) for r in R.geometry_aois(df, cells_of(spark)).collect()}
    edges = {"small": shapes[0][1][0] + shapes[0][1][0][:1], "large": shapes[1][1][0] + shapes[1][1][0][:1], "line": shapes[2][2]}
    for name, path in edges.items():
        want = set()
        for i in range(20):
            for j in range(20):
                w, s = -0.4 + 0.04 * i, -0.4 + 0.04 * j
                steps = [(x1 + (x2 - x1) * t / 400, y1 + (y2 - y1) * t / 400) for (x1, y1), (x2, y2) in zip(path, path[1:], strict=False) for t in range(401)]
                if any(w <= x <= w + 0.04 and s <= y <= s + 0.04 for x, y in steps) or (name != "line" and inside([path[:-1]], w, s)):
                    want.add((name, f"{i}:{j}"))
        mine = {g for g in got if g[0] == name}
        # the sampled path may miss a corner that an edge only grazes
        assert want <= mine and len(mine - want) <= 2, name
    assert {a for a, _ in got} == set(edges)
    one = R.create_aoi("mine", cells_of(spark), geometry=df.where("aoi_id in ('small', 'line')"))
    assert {r.cell_id for r in one.collect()} == {c for a, c in got if a in ("small", "line")}
    with pytest.raises(ValueError, match="no cells"):
        R.create_aoi("mine", cells_of(spark), geometry=df.where("aoi_id = 'far'"))


def test_covered_share_is_exact(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0, 0.01, 0.01), ("b", 0.01, 0.0, 0.01, 0.01), ("c", 0.02, 0.0, 0.01, 0.01), ("e", 0.5, 0.5, 0.01, 0.01)], CELL)
    k = 0.001
    ring = lambda *p: [(x * k, y * k) for x, y in p]
    shapes = [(1, [ring((0, 0), (4, 0), (4, 4), (0, 4))]), (2, [ring((2, 2), (6, 2), (6, 6), (2, 6))]), (2, [ring((2, 2), (6, 2), (6, 6), (2, 6))]),
              (3, [ring((1, 6), (9, 6), (5, 10))]), (4, [ring((5, 6), (9, 10), (1, 10))]), (5, [ring((12, 2), (18, 2), (18, 8), (12, 8)), ring((14, 4), (16, 4), (16, 6), (14, 6))]),
              (6, [ring((8, -3), (12, -3), (12, 1), (8, 1))]), (7, [ring((-9, -9), (60, -9), (60, -1), (-9, -1))]), (8, [ring((19, -1), (31, -1), (31, 11), (19, 11))])]
    df = frame(spark, shapes[:2] + shapes[3:], "building_id int")
    got = {r.cell_id: (r.building_count, round(r.building_share * 100, 9)) for r in G.building_zonal(df, cells).collect()}
    # a: two squares of 16 that share 4, two triangles of 16 that share 8, a corner of 2; b: a frame of 32, a corner of 2 and a strip of 10
    assert got == {"a": (5, 28 + 24 + 2), "b": (3, 32 + 2 + 10), "c": (1, 100), "e": (0, 0)}


def test_covered_share_of_many_overlapping_stars(spark):
    rnd = random.Random(9)
    cells = spark.createDataFrame([(f"{i}{j}", 0.01 * i, 0.01 * j, 0.01, 0.01) for i in range(3) for j in range(3)], CELL)
    shapes = [(b, [star(rnd, rnd.uniform(0, 0.03), rnd.uniform(0, 0.03), rnd.choice([0.001, 0.004, 0.012]), rnd.choice([4, 7, 11]))]) for b in range(25)]
    got = {r.cell_id: r.building_share for r in G.building_zonal(frame(spark, shapes, "building_id int"), cells).collect()}
    n = 90
    for i in range(3):
        for j in range(3):
            hits = sum(any(inside(r, 0.01 * (i + (a + 0.5) / n), 0.01 * (j + (b + 0.5) / n)) for _, r in shapes) for a in range(n) for b in range(n))
            assert abs(got[f"{i}{j}"] - hits / n / n) < 0.01
    assert spark.createDataFrame([], "x int").isEmpty() and G.building_zonal(spark.createDataFrame([], f"building_id int, rings {RINGS}"), cells).agg(F.sum("building_count")).first()[0] == 0
