"""Pixel tables, boundary, areas, grid and evaluation on small inputs."""
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.functions.cells import cell_dimension, with_cell, with_centroid
from obsweave.operators import areas as R
from obsweave.operators import assess as A
from obsweave.operators import boundary as BD
from obsweave.operators import evaluate as E
from obsweave.operators import grid as G
from obsweave.operators import raster as RS
from obsweave.sources import feeds

TILE = "tile_id string, w double, s double, e double, n double, acq_start timestamp, acq_end timestamp, height int, width int, scale_m double"


def stack(spark, arrays, band="VV"):
    from datetime import datetime, timedelta
    tiles, px = [], []
    for i, a in enumerate(arrays):
        t = datetime(2024, 1, 1) + timedelta(days=i)
        tiles.append((f"t{i}", 37.0, 48.0, 37.1, 48.1, t, t + timedelta(hours=1), a.shape[0], a.shape[1], 100.0))
        px += [(f"t{i}", band, int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(px, feeds.TILE_SCHEMA), spark.createDataFrame(tiles, TILE)


def test_radar_change(spark):
    base = np.zeros((12, 12))
    hot = base.copy()
    hot[4:7, 4:6] = 6.0
    hot[0, 0] = 9.0           # speckle
    hot[10, 10:12] = 3.0      # below the threshold
    assert RS.sar_logratio(*stack(spark, [base, base])).count() == 0
    assert RS.sar_logratio(*stack(spark, [base])).count() == 0
    r = RS.sar_logratio(*stack(spark, [base, hot])).collect()
    assert len(r) == 1 and r[0].n_pixels == 6 and r[0].direction == "increase" and r[0].self_conf == 0.45
    assert abs(r[0].lon - (37.0 + 5.0 * 0.1 / 12)) < 1e-9 and abs(r[0].lat - (48.1 - 5.5 * 0.1 / 12)) < 1e-9
    placed, lost = RS.coarsen_detections(RS.sar_logratio(*stack(spark, [base, hot])), spark.createDataFrame([("x",)], "cell_id string"))
    assert placed.count() == 0 and lost.count() == 1


def test_vessels_and_median(spark):
    sea = np.full((20, 20), -20.0) + np.arange(400).reshape(20, 20) % 3 * 0.1
    assert RS.vessel_cfar(*stack(spark, [sea])).count() == 0
    ships = sea.copy()
    ships[3:5, 3:5] = 0.0
    ships[12:14, 12:14] = -2.0
    ships[18, 1] = 5.0        # one pixel
    ships[:, 19] = -40.0      # land
    assert RS.vessel_cfar(*stack(spark, [ships])).count() == 2
    v = np.random.default_rng(1).normal(size=301)
    for n in (300, 301):
        d = spark.createDataFrame([("k", float(x)) for x in v[:n]], "k string, v double")
        assert abs(RS.exact_median(d, "k", "v").first().median - float(np.median(v[:n]))) < 1e-12


def test_registry_cache_and_hash(spark):
    with pytest.raises(ValueError):
        RS.DETECTORS.register("sar_logratio", RS.sar_logratio)
    tiles = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    cache = spark.createDataFrame([("a", 1)], "cache_key string, v int")
    all_, fresh = RS.cached_detect(tiles, cache, lambda t: t.withColumn("v", F.lit(2)))
    assert {(r.cache_key, r.v) for r in all_.collect()} == {("a", 1), ("b", 2)} and fresh.count() == 1


def test_tiles_from_files(spark, tmp_path):
    np.save(tmp_path / "t1.npy", np.arange(8, dtype="float32").reshape(2, 2, 2))
    d = feeds.read_tiles(spark, str(tmp_path), ["VV", "VH"]).orderBy("value").collect()
    assert len(d) == 8 and (d[5].band, d[5].row, d[5].col, d[5].value) == ("VH", 0, 1, 5.0)


def test_codec_round_trip(spark):
    pts = spark.createDataFrame([(37.749, 48.1394), (36.0, 46.8), (55.9, 26.1), (77.1, 28.5), (33.5, 44.6)], "lon double, lat double")
    d = with_cell(pts, "lon", "lat").collect()
    assert d[0].cell_id == "37UDP0632"
    back = with_centroid(with_cell(pts, "lon", "lat").select("lon", "lat", "cell_id"), prefix="c_")
    for r in back.collect():
        assert r.c_sw_lon - 0.002 <= r.lon <= r.c_sw_lon + r.c_step_lon + 0.002 and r.c_sw_lat - 0.001 <= r.lat <= r.c_sw_lat + r.c_step_lat + 0.001
    g = G.build_grid(spark, (37.0, 48.0, 37.05, 48.05))
    assert 15 <= g.count() <= 42 and cell_dimension(g.select("cell_id")).count() == g.count()


def test_boundary(spark):
    leak = spark.createDataFrame([("c", None), ("c", 1.0)], "cell_id string, lon double")
    with pytest.raises(BD.BoundaryError):
        BD.assert_no_precise_coords(leak)
    BD.assert_no_precise_coords(leak.where("lon is null"))
    with pytest.raises(BD.BoundaryError):
        BD.assert_no_person(spark.createDataFrame([("Person",)], "kind string"))
    d = BD.coarsen(spark.createDataFrame([("37UDP0632", "text")], "cell_id string, modality string"), spark.createDataFrame([("37UDP0632",)], "cell_id string"))
    assert d.first().geometry.startswith('{"type":"Point","coordinates":[37.7')


def test_zonal_lines_and_buildings(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0, 0.01, 0.01), ("b", 0.01, 0.0, 0.01, 0.01), ("c", 0.5, 0.5, 0.01, 0.01)],
                                  "cell_id string, sw_lon double, sw_lat double, step_lon double, step_lat double")
    line = spark.createDataFrame([(1, "primary", [(-1.0, 0.005), (0.02, 0.005)])], "road_id int, highway string, vertices array<struct<x:double,y:double>>")
    assert sorted(r.cell_id for r in G.lines_on_cells(line, cells, ["road_id", "highway"]).collect()) == ["a", "b"]
    boxes = [(1, 0.0, 0.0, 0.005, 0.01), (2, 0.0025, 0.0, 0.005, 0.01), (3, 0.0101, 0.0, 0.0102, 0.0001)]
    b = spark.createDataFrame([(k, [[(w, s), (e, s), (e, n), (w, n)]]) for k, w, s, e, n in boxes], "building_id int, rings array<array<struct<x:double,y:double>>>")
    r = {x.cell_id: (x.building_count, round(x.building_share, 9)) for x in G.building_zonal(b, cells).collect()}
    assert r["a"] == (2, 0.5) and r["b"][0] == 1 and r["c"] == (0, 0.0)
    tags = spark.createDataFrame([({"waterway": "river", "highway": "primary"},), ({"highway": "track"},), ({"landuse": "forest"},)], "tags map<string,string>")
    assert [r.k and (r.k.kind, r.k.subkind) for r in tags.select(G.classify_feature(F.col("tags")).alias("k")).collect()] == [("water", "river"), None, ("forest", "forest")]


def test_nearest_place_is_exact_at_any_distance(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(20, 40, 30), rng.uniform(40, 60, 30)))], "cell_id string, lon double, lat double")
    places = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(20, 24, 40), rng.uniform(40, 44, 40)))], "name string, lon double, lat double")
    got = {r.cell_id: r.name for r in A.nearest_place(cells, places).collect()}
    ps = places.collect()

    def km(a, b):
        p = np.radians
        h = np.sin(p(b.lat - a.lat) / 2) ** 2 + np.cos(p(a.lat)) * np.cos(p(b.lat)) * np.sin(p(b.lon - a.lon) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))
    assert got == {c.cell_id: min(ps, key=lambda q: km(c, q)).name for c in cells.collect()}


def test_reads_fall_back_and_refresh(spark):
    f = spark.createDataFrame([("x", 5, 1, 2, 3, 0, 2, 1, "strike=5", "strike", ["escalation"], ["thermal"])],
                              "area string, n_events long, High long, Medium long, Low long, Rumored long, recent long, prior long, by_type string, top_type string, anomalies array<string>, sensors array<string>")
    att = spark.createDataFrame([("x", "escalating")], "area string, status string")
    base = R.synthesize_areas(f, att)
    assert base.first().summary == ("x: 5 recorded events, mostly strike. Activity is rising (2 in the last 45 days vs 1 before). "
                                    "A new, more-severe event type has appeared here. 1 event(s) are multi-source confirmed.")
    blank = R.synthesize_areas(f, att, generate=lambda d: d.select("area", F.lit(" ").alias("summary")))
    assert blank.first().generated_by == "template"
    cached = base.withColumn("summary", F.lit("kept"))
    assert R.synthesize_areas(f, att, cached).first().summary == "kept"
    assert R.synthesize_areas(f.withColumn("recent", F.lit(9)), att, cached).first().summary != "kept"


def test_areas_and_gate_helpers(spark):
    ctx = spark.createDataFrame([("c1", "A", "B", None), ("c2", "A", None, None)], "cell_id string, admin1_id string, admin2_id string, admin3_id string")
    assert R.create_aoi("z", ctx, admin_id="A").count() == 2
    with pytest.raises(ValueError):
        R.create_aoi("z", ctx, admin_id="Q")
    assert E.rethreshold(spark.createDataFrame([(0.9, True), (0.5, False)], "p double, same boolean"), 0.38, 0.82).first().gray == 1
    sweep = E.parameter_sweep(spark.createDataFrame([(3.0, "a", 5), (3.0, "b", 9)], "threshold double, cell_id string, n_pixels int"), spark.createDataFrame([("b",)], "cell_id string"), [3.0], [4, 6])
    assert {(r.min_px, r.n_detected, r.precision) for r in sweep.collect()} == {(4, 2, 0.5), (6, 1, 1.0)}


def test_areas_without_events_stay(spark):
    from datetime import datetime

    now = "2024-06-01 00:00:00"
    cells = spark.createDataFrame([("admin:a", "c1"), ("admin:b", "c2")], "area string, cell_id string")
    events = spark.createDataFrame([("c1", datetime(2024, 5, d), 2) for d in (20, 21, 22)], "cell_id string, occurred_start timestamp, n_independent_families int")
    anomalies = spark.createDataFrame([("c1", "activity_spike", 1.0)], "cell_id string, subkind string, score double")
    att = {r.area: r for r in R.area_attention(cells, events, anomalies, now).collect()}
    assert (att["admin:a"].status, att["admin:a"].n_events, att["admin:a"].confirmed, att["admin:a"].has_spike) == ("escalating", 3, 3, True)
    assert (att["admin:b"].status, att["admin:b"].n_events, att["admin:b"].trend_score, att["admin:b"].has_spike) == ("steady", 0, 0.0, False)
    # a unit that holds no cell at all is still a child
    units = spark.createDataFrame([("a", "A", "p"), ("b", "B", "p"), ("z", "Z", "p"), ("p", "P", None)], "admin_id string, name string, parent_id string")
    kids = R.area_children(units, cells, events, now).collect()
    assert [(r.admin_id, r.status, r.rank) for r in sorted(kids, key=lambda r: r["rank"])] == [("a", "escalating", 1), ("b", "steady", 2), ("z", "steady", 3)]
    reads = spark.createDataFrame([("admin:a", "text", "template")], "area string, summary string, generated_by string")
    full = R.area_attention(cells, events, None, now)
    assert [(r.area, r.summary) for r in R.watch_list(full, reads).collect()] == [("admin:a", "text"), ("admin:b", None)]
    assert R.needs_attention(full).first() == (2, 1)


def test_median_by_refined_histograms(spark):
    rng = np.random.default_rng(5)
    rows = [("even", 1.0), ("even", 4.0), ("one", 7.0), ("same", 2.0), ("same", 2.0), ("null", None)] + [("big", float(x)) for x in np.round(rng.normal(0, 50, 3001), 3)]
    rows += [("wide", float(x)) for x in [*(10.0 ** rng.uniform(-9, 9, 500)), -1e12, float("nan")]]
    got = {r.k: r.median for r in RS.exact_median(spark.createDataFrame(rows, "k string, value double"), "k", "value", bins=16).collect()}
    for k in {k for k, _ in rows} - {"null"}:
        assert got.pop(k) == np.median([v for n, v in rows if n == k and v == v])
    assert got == {}


def test_shapes_within_halves(spark):
    rows = [(f"{fp}{i}", fp, i, h) for fp, hs in (("a", [4, 4, 4, 5]), ("b", [4, 5, 5, 5]), ("c", [4, 4, 6, 6])) for i, h in enumerate(hs)]
    fps = {"a": 1.0, "b": 2.0, "c": 3.0}
    tiles = spark.createDataFrame([(t, datetime(2024, 1, 1 + i), datetime(2024, 1, 1 + i, 1), h, 4, fps[fp], 0.0, fps[fp] + 1, 1.0) for t, fp, i, h in rows],
                                  "tile_id string, acq_start timestamp, acq_end timestamp, height int, width int, w double, s double, e double, n double")
    # a: the last tile of the second half differs from its first; b: the halves' first tiles differ; c too
    assert sorted(r.tile_id for r in RS.group_footprint(tiles).collect()) == ["a0", "a1", "a2"]


def test_a_failing_area_keeps_its_template(spark):
    def model(rows):
        if any(r["area"] == "x" for r in rows):
            raise RuntimeError("no answer")
        return [f"text of {r['area']}" for r in rows]

    changed = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "area string, n int").coalesce(1)
    assert {r.area: r.summary for r in R.generate_by_model(model)(changed).collect()} == {"x": None, "y": "text of y", "z": "text of z"}
