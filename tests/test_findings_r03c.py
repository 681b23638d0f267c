"""Faults of the third round at size: work that grew faster than the input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from obsweave.operators import polygons as P

RINGS = "array<array<struct<x:double,y:double>>>"


def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n)]]


def strips(spark, n):
    return spark.createDataFrame([(i, box(36.0, 46.8 + 0.54 * i / n, 36.7, 46.8 + 0.54 * (i + 1) / n)) for i in range(n)], f"strip int, rings {RINGS}")


@pytest.mark.parametrize("n", [20, 700])
def test_a_point_meets_few_of_many_thin_polygons(spark, n):
    """However many strips a unit is cut into, one square holds the edges of a few."""
    cut, _, forms = P.fitted_cover(P.ring_edges(strips(spark, n), "strip"), "strip")
    assert forms.count() == 1
    most = cut.groupBy("hx", "hy", "i", "j").count().agg(F.max("count")).first()[0]
    assert most <= 16
    pts = [(f"p{i}", 36.0003 + 0.0071 * i, 46.80007 + 0.0053 * i) for i in range(90)]
    got = P.points_in_polygons(spark.createDataFrame(pts, "cell_id string, lon double, lat double"), strips(spark, n), shape="strip")
    assert {r.cell_id: r.strip for r in got.collect()} == {p: int((y - 46.8) / 0.54 * n) for p, _, y in pts}


def test_equal_footprints_are_swept_once(spark, monkeypatch):
    sizes, write = [], P.cut_table
    monkeypatch.setattr(P, "cut_table", lambda d: (lambda t: (sizes.append(t.count()), t)[1])(write(d)))
    foot = spark.createDataFrame([(i, box(0.2, 0.2, 0.6, 0.7) if i % 2 else box(0.4, 0.4, 0.8, 0.8)) for i in range(300)], f"building_id int, rings {RINGS}")
    cells = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 1.0, 1.0)], "cell_id string, sw_lon double, sw_lat double, step_lon double, step_lat double")
    got = {r.cell_id: (r.building_count, round(r.building_share, 9)) for r in P.covered_share(foot, cells, size=0.5).collect()}
    assert got == {"a": (300, 0.3), "b": (0, 0.0)}
    assert max(sizes) <= 20
