"""Feeds, normalisation, sinks and the streaming form."""
import json
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions.cells import with_cell
from obsweave.functions.timegeo import parse_acq_time, parse_date_multi
from obsweave.operators import ingest as I
from obsweave.sources import feeds, sinks
from obsweave.sources.quoted_csv import read_quoted_csv
from obsweave.streaming import ingest_stream as ST

UTC = timezone.utc


def ts(*a):
    return datetime(*a, tzinfo=UTC)


def local(v):
    return v.astimezone(UTC) if v.tzinfo else v


def test_conflict_feed(spark, tmp_path):
    head = ",".join(feeds.CONFLICT_COLUMNS)
    rows = ['1,48.1394,37.749,Avdiivka,Donetsk,,,2024-03-10,2024-03-11,1,12,War,,Ukraine," some  article",,500',
            '2,,,,,,,2024-03-10,,3,0,,dyad,Ukraine,,,', '3,48.0,37.5,,Luhansk,,,,2024/03/12,3,0,,dyad,Ukraine,,,']
    (tmp_path / "c.csv").write_text("\n".join([head, *rows]))
    out = feeds.parse_conflict_row(feeds.read_conflict_events(spark, str(tmp_path / "c.csv"))).orderBy("lat").collect()
    assert [r.obs_type for r in out] == ["other", "strike"]
    assert out[1].text == "War — Avdiivka; best fatality estimate 12; some  article" and out[1].geom_precision_m == 500
    assert out[0].text == "dyad — Luhansk" and out[0].occurred_start == out[0].occurred_end
    read = feeds.read_conflict_events(spark, str(tmp_path / "c.csv"))
    lost = feeds.conflict_rejections(read).collect()
    assert [(r.reason, r.source_id) for r in lost] == [("no_place", "ucdp_ged_bulk")] and json.loads(lost[0].raw_payload)["id"] == "2"
    long = read.where("id = '1'").withColumn("source_article", F.repeat(F.lit("x"), 500))
    assert feeds.parse_conflict_row(long).first().text.endswith("x" * 500)
    assert feeds.parse_conflict_row(long, text_limit=160).first().text.endswith("; " + "x" * 160)
    (tmp_path / "c.json").write_text(json.dumps({"Result": [{"id": 1, "latitude": 48.1, "longitude": 37.7, "date_start": "2024-01-01"}]}))
    assert feeds.read_conflict_events(spark, str(tmp_path / "c.json"), "json").first().latitude == "48.1"


def test_combined_files_first_row_wins(spark, tmp_path):
    (tmp_path / "cand").mkdir()
    (tmp_path / "GED_v1.csv").write_text("id,latitude,longitude,country,date_start,best\n1,48,37,Ukraine,2023-01-01,5\n2,48,37,Poland,2023-01-01,5\n")
    (tmp_path / "cand" / "a.csv").write_text("id,latitude,longitude,country,date_start,best\n1,48,37,Ukraine,2023-01-01,9\n3,48,37,Ukraine,2021-01-01,1\n4,48.1,37,Ukraine,2022-12-01 00:00,1\n")
    d = feeds.combine_event_files(spark, f"{tmp_path}/GED_v*.csv", f"{tmp_path}/cand/*.csv", "Ukraine", "2022-02-24", (36, 46, 40, 50)).collect()
    assert [(r.id, r.best) for r in d] == [("4", "1"), ("1", "5")]


def test_fire_feed_and_confidence(spark, tmp_path):
    (tmp_path / "v.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,confidence,frp\n48.1,37.7,2024-03-10,45,N,n,3.2\n48.1,37.7,2024-03-10,2610,N,n,3.2\n,37.7,2024-03-10,45,N,n,3.2\n")
    (tmp_path / "m.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,confidence,frp\n48.1,37.7,2024-03-10,1305,Terra,140,1\n")
    d = feeds.parse_fire_row(feeds.read_fire_detections(spark, {"VIIRS_SNPP_NRT": f"{tmp_path}/v.csv", "MODIS_NRT": f"{tmp_path}/m.csv"})).orderBy("occurred_start").collect()
    assert [(r.source_id, r.self_conf) for r in d] == [("firms_viirs_snpp", 0.6), ("firms_modis", 1.0)]
    lost = feeds.fire_rejections(feeds.read_fire_detections(spark, {"VIIRS_SNPP_NRT": f"{tmp_path}/v.csv", "MODIS_NRT": f"{tmp_path}/m.csv"}))
    assert sorted(r.reason for r in lost.collect()) == ["no_date", "no_place"]
    assert d[0].text == "active fire detection (N) at 2024-03-10T00:45:00+00:00; FRP 3.2 MW; confidence n"
    one = spark.range(1).select(parse_date_multi(F.lit("2024/03/01")).alias("a"), parse_date_multi(F.lit("x")).alias("b"), parse_acq_time(F.lit("2024-01-01"), F.lit("5")).alias("c"))
    r = one.first()
    assert r.a is not None and r.b is None and r.c is not None


def test_geo_feeds(spark, tmp_path):
    pt = lambda g, d, x: {"properties": {"damage": g, "city": "M", "date": d}, "geometry": {"type": "Point", "coordinates": [x, 47.1]}}
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [pt(2, "2022-05-08", 37.5), pt(4, "2022-05-08T00:00", 37.5001), pt(6, "2022-05-08", 37.5)]}))
    r = feeds.aggregate_damage(feeds.read_damage_points(spark, f"{tmp_path}/d.geojson"), (36, 46, 40, 50)).collect()
    assert len(r) == 1 and (r[0].n, r[0].worst, r[0].self_conf) == (2, 4, 0.9)
    assert r[0].text == "UNOSAT satellite assessment: 2 damaged structure(s) (destroyed) in M as of 2022-05-08"
    row = lambda i, cls: "\t".join([str(i), f"P{i}", "", "", "48.0", "37.5", cls, "PPL", "UA", "", "", "", "", "", "1000", "", "", "", "x"])
    (tmp_path / "g.tsv").write_text("\n".join([row(1, "P"), row(2, "R"), "short\trow"]))
    places = feeds.read_gazetteer(spark, f"{tmp_path}/g.tsv", (36, 46, 40, 50))
    assert [p.place_id for p in places.collect()] == [1]
    (tmp_path / "a.tsv").write_text("9\t1\tuk\tПетро\t1\n8\t1\tfr\tx\n7\t2\ten\ty\n")
    assert [(a.name, a.is_preferred) for a in feeds.read_alternate_names(spark, f"{tmp_path}/a.tsv", places).collect()] == [("Петро", True)]
    poly = {"type": "FeatureCollection", "features": [{"properties": {"shapeID": "u1", "shapeName": "U"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "u.geojson").write_text(json.dumps(poly))
    u = feeds.read_admin_boundaries(spark, f"{tmp_path}/u.geojson", 1)
    assert len(u.first().rings) == 2
    from obsweave.operators.grid import points_in_polygons
    pts = spark.createDataFrame([("a", 1.0, 1.0), ("b", 3.0, 1.0), ("c", 5.7, 5.2)], "cell_id string, lon double, lat double")
    assert sorted(x.cell_id for x in points_in_polygons(pts, u).collect()) == ["a", "c"]


def test_json_elements_are_cut_at_any_block(spark, tmp_path):
    """Every size of block gives the objects that a JSON parser finds; braces, quotes and escapes in strings do not count."""
    from obsweave.sources.json_elements import json_elements
    made = random.Random(5)
    odd = ["}", "{", '"', "\\", "a}b{", '\\"}', "é}", "", '"features": [{'] + ["x" * 90]
    feature = lambda i: {"type": "Feature", "id": i, "properties": {"t": "".join(made.choices(odd, k=made.randrange(6))), "more": [{"k": i}, {}]}, "geometry": {"c": [[i, 1.5]] * made.randrange(9)}}
    docs = {"a": {"crs": {"name": "}{"}, "note": 'a "}" b', "other": [{"id": -1}], "features": [feature(i) for i in range(60)], "tail": [{"id": -2}], "last": {"features": [{"id": -3}]}},
            "b": [feature(i) for i in range(20)], "c": {"features": []}, "d": {"none": [{"id": 1}]}, "e": {"features": [feature(0)]}}
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (name, doc) in enumerate(docs.items()):
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=1 if k % 2 else None, ensure_ascii=False))
    want = {"a": docs["a"]["features"], "b": docs["b"], "e": docs["e"]["features"]}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n in (64, 333, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
            got = {}
            for r in sorted(json_elements(spark, str(folder), "features").collect()):
                got.setdefault(r.file_path[-6], []).append(json.loads(r.text))
            assert got == want, n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_period_aggregation(spark):
    cols = "seq long, longitude string, latitude string, date_start string, best string, type_of_violence string, adm_1 string, adm_2 string, where_coordinates string, conflict_name string"
    rows = [(1, "37.749", "48.1394", "2024-03-01", "2", "3", "D", "", "", "War"), (2, "37.749", "48.1394", "2024-03-05", "4", "1", "", "Bakhmut", "", ""),
            (3, "37.749", "48.1394", "2024-04-01", "0", "1", "", "", "", ""), (4, "x", "48.1", "2024-03-01", "0", "1", "", "", "", "")]
    d = feeds.aggregate_periods(spark.createDataFrame(rows, cols), (36, 46, 40, 50)).orderBy("period").collect()
    assert [(r.period, r.n, r.deaths, r.dominant, r.obs_type, r.self_conf) for r in d] == [("2024-03", 2, 6, 3, "other", 0.85), ("2024-04", 1, 0, 1, "strike", 0.78)]
    assert d[0].text == "UCDP: 2 armed-conflict event(s) near Bakhmut (2024-03-01…2024-03-05); 6 fatalities — War"
    w = spark.range(1).select(I.period_key(F.lit("2024-12-30").cast("timestamp"), "week").alias("w")).first().w
    assert w == "2025-W01"


RAW = "seq long, theater_id string, source_id string, modality string, obs_type string, occurred_start timestamp, occurred_end timestamp, lon double, lat double, geom_precision_m double, place_id long, text string"


def raw_rows():
    t = ts(2024, 3, 10, 8, 5)
    mk = lambda i, **k: tuple({**dict(seq=i, theater_id="t", source_id="gdelt_v2", modality="text", obs_type="strike", occurred_start=t, occurred_end=t,
                                      lon=37.749, lat=48.1394, geom_precision_m=300.0, place_id=None, text="Strike at  plant"), **k}.values())
    return [mk(1), mk(2, text="strike at plant "), mk(3, modality="sonar", obs_type="bad"), mk(4, obs_type="bad"), mk(5, lon=10.0), mk(6, geom_precision_m=800.0, text="other")]


def test_normalize_reasons_and_identity(spark):
    raw = spark.createDataFrame(raw_rows(), RAW)
    grid = spark.createDataFrame([("37UDP0632",)], "cell_id string")
    obs, rej = I.normalize(raw, grid, "seq")
    assert {r.seq: r.reason for r in rej.collect()} == {2: "exact_dup", 3: "invalid_modality", 4: "invalid_type", 5: "no_cell_resolve"}
    got = {r.seq: r for r in obs.collect()}
    assert set(got) == {1, 6} and got[1].resolution == "PRECISE" and got[6].resolution == "COARSE"
    assert got[1].occurred_end > got[1].occurred_start and got[1].cell_id == "37UDP0632" and "lon" not in obs.columns
    n = {r.counter: r.n for r in I.ingest_counters(raw, obs, rej).collect()}
    assert n["seen"] == 6 and n["ingested"] == 2 and n["rejected"] == 4


def test_place_resolution(spark):
    alias = spark.createDataFrame([(1, 10, "Bakhmut", False, "c1"), (2, 11, "bakhmut", True, "c2"), (3, 12, "Kramatorsk", True, "c3"), (4, 13, "Sloviansk", True, "c4")],
                                  "alias_id long, place_id long, name string, is_preferred boolean, cell_id string")
    names = spark.createDataFrame([("BAKHMUT ",), ("Kramatorsk city",), ("Slovyansk",), ("zzz",)], "place_name string")
    assert [(r.place_id, r.cell_id) for r in I.resolve_place_exact(names, alias).collect()] == [(11, "c2")]
    fz = {r.place_name: (r.place_id, r.similarity) for r in I.resolve_place_fuzzy(names, alias).collect()}
    assert fz["Kramatorsk city"][0] == 12 and "zzz" not in fz
    # against brute force over all name pairs
    from obsweave.functions.text import pg_trigrams
    a, q = alias.select("alias_id", pg_trigrams(F.col("name")).alias("g")).collect(), names.select("place_name", pg_trigrams(F.col("place_name")).alias("g")).collect()
    for x in q:
        best = max((len(set(x.g) & set(y.g)) / len(set(x.g) | set(y.g)) for y in a), default=0)
        assert (x.place_name in fz) == (best > 0.4)
        if best > 0.4:
            assert abs(fz[x.place_name][1] - best) < 1e-5
    raw = spark.createDataFrame([(1, 10.0, 10.0, 100.0, "Bakhmut"), (2, None, None, 0.0, "nowhere")], "seq long, lon double, lat double, geom_precision_m double, place_name string")
    r = {x.seq: x for x in I.resolve_to_cell(raw, spark.createDataFrame([("c9",)], "cell_id string"), alias).collect()}
    assert r[1].cell_id == "c2" and r[1].place_name_only and r[1].resolution == "place_only" and r[2].cell_id is None


def test_places_are_looked_up_in_their_theater(spark):
    """An alias of another theater does not count; one without a cell is placed by its point or not at all."""
    cols = "alias_id long, place_id long, name string, is_preferred boolean, cell_id string, theater_id string, lon double, lat double"
    alias = spark.createDataFrame([(1, 10, "Bakhmut", True, "c1", "b", None, None), (2, 11, "Bakhmut", None, None, "a", 37.749, 48.1394), (3, 12, "Kramatorsk", True, None, "a", None, None),
                                   (4, 13, "Kramatorsky", True, "c4", "a", None, None), (5, 14, "Toretsk", True, "c5", "b", None, None), (6, 15, "Far", True, None, "a", 10.0, 10.0)], cols)
    rec = [(1, "a", "bakhmut "), (2, "b", "BAKHMUT"), (3, "a", "Kramatorsk"), (4, "a", "Toretsk"), (5, "a", "Kramatorskyi"), (6, None, "Bakhmut"), (7, "a", ""), (8, "a", None), (9, "a", "far")]
    raw = spark.createDataFrame([(i, t, n, None, None, 0.0) for i, t, n in rec], "seq long, theater_id string, place_name string, lon double, lat double, geom_precision_m double")
    r = {x.seq: (x.cell_id, x.place_id, x.resolved_by) for x in I.resolve_to_cell(raw, spark.createDataFrame([("37UDP0632",)], "cell_id string"), alias).collect()}
    assert r[1] == ("37UDP0632", 11, "exact") and r[2] == ("c1", 10, "exact") and r[5] == ("c4", 13, "fuzzy")
    assert all(r[i] == (None, None, None) for i in (3, 4, 6, 7, 8, 9)) and len(r) == 9


def test_sinks_and_guards(spark, tmp_path):
    raw = spark.createDataFrame(raw_rows(), RAW)
    grid = spark.createDataFrame([("37UDP0632",)], "cell_id string")
    obs, _ = I.normalize(raw, grid, "seq")
    log, led = f"{tmp_path}/log", f"{tmp_path}/ledger"
    assert sinks.append_observations(obs, log, led, "seq") == {"ingested": 2, "exact_dup": 0}
    assert sinks.append_observations(obs, log, led, "seq") == {"ingested": 0, "exact_dup": 2}
    assert spark.read.parquet(log).count() == 2 and spark.read.parquet(led).count() == 2
    rm = f"{tmp_path}/events"
    one = spark.createDataFrame([("t1", 1), ("t2", 2)], "theater_id string, v int")
    sinks.write_read_model(one, rm)
    sinks.write_read_model(spark.createDataFrame([("t2", 3)], "theater_id string, v int"), rm)
    assert sorted(r.v for r in spark.read.parquet(rm).collect()) == [1, 3]
    sinks.append_annotation(spark.createDataFrame([("e", "confirm")], "event_id string, action string"), f"{tmp_path}/rev", "review")
    with pytest.raises(ValueError):
        sinks.append_annotation(spark.createDataFrame([("e", "maybe")], "event_id string, action string"), f"{tmp_path}/rev", "review")
    assert sinks.append_unseen(one, f"{tmp_path}/cache", "v") == 2 and sinks.append_unseen(one, f"{tmp_path}/cache", "v") == 0
    sinks.export_views({"events": one}, f"{tmp_path}/out")
    assert (tmp_path / "out" / "events" / "theater_id=t1").exists()
    with pytest.raises(Exception, match="forbidden source"):
        I.assert_source_permitted(spark.createDataFrame([("Bad Feed",)], "source string"), ["bad"]).collect()


def test_embedding_hook(spark):
    d = spark.createDataFrame([("a",), (" ",), (None,)], "text string")
    got = {r.text: r.embedding for r in I.embed_text(d, lambda texts: [[1.0, 2.0] for _ in texts], 2).collect()}
    assert got == {"a": [1.0, 2.0], " ": None, None: None}
    with pytest.raises(Exception, match="embedding size"):
        I.embed_text(d, lambda texts: [[1.0] for _ in texts], 2).collect()


def test_streaming_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    names = RAW.replace(",", "").split()[::2]
    for k in (0, 3):
        rows = [dict(zip(names, r)) for r in raw_rows()[k:k + 3]]
        (src / f"{k}.json").write_text("\n".join(json.dumps(r, default=lambda v: v.isoformat()) for r in rows))
    grid = spark.createDataFrame([("37UDP0632",)], "cell_id string")
    q = ST.start_ingest(ST.raw_stream(spark, str(src), 1), grid, f"{tmp_path}/log", f"{tmp_path}/led", f"{tmp_path}/ck")
    q.awaitTermination(120)
    obs, rej = I.normalize(spark.createDataFrame(raw_rows(), RAW), grid, "seq")
    assert {r.obs_id for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {r.obs_id for r in obs.collect()}
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/led").collect()) == sorted(r.reason for r in rej.collect())


def test_replayed_batch_changes_nothing(spark, tmp_path):
    grid = spark.createDataFrame([("37UDP0632",)], "cell_id string")
    log, led = f"{tmp_path}/log", f"{tmp_path}/led"
    run = ST.ingest_batch(grid, log, led)
    state = lambda: (sorted(r.content_hash for r in spark.read.parquet(log).collect()),
                     sorted((r.batch_id, json.loads(r.raw_payload)["seq"], r.reason) for r in spark.read.parquet(led).collect()))
    batch = spark.createDataFrame(raw_rows(), RAW)
    # the log holds a row of another writer, without a batch
    obs, _rej = I.normalize(batch.where("seq = 6"), grid, "seq")
    sinks.append_observations(obs, log, f"{tmp_path}/other", "seq")
    run(batch, 0)
    first = state()
    assert (0, 6, "exact_dup") in first[1] and len(first[0]) == 2
    run(batch, 0)
    assert state() == first
    run(batch, 1)
    assert state()[0] == first[0] and sum(b == 1 for b, _, _ in state()[1]) == 6


def test_stream_keeps_place_names(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = dict(seq=1, theater_id="t", source_id="gdelt_v2", modality="text", obs_type="strike", occurred_start="2024-03-10T08:05:00Z", occurred_end="2024-03-10T08:05:00Z",
               place_name="Plant", self_conf=0.5, meta="m", text="strike")
    (src / "0.json").write_text(json.dumps(row))
    grid = spark.createDataFrame([("37UDP0632",)], "cell_id string")
    alias = spark.createDataFrame([(1, 7, "plant", True, "37UDP0632")], "alias_id long, place_id long, name string, is_preferred boolean, cell_id string")
    q = ST.start_ingest(ST.raw_stream(spark, str(src), 1), grid, f"{tmp_path}/log", f"{tmp_path}/led", f"{tmp_path}/ck", alias)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/log").collect()
    assert [(r.cell_id, r.place_id, r.resolution, r.self_conf, r.meta) for r in got] == [("37UDP0632", 7, "place_only", 0.5, "m")]


def test_dims_tables(spark):
    d = dims.load_reference_dims(spark)
    assert d["types"].count() == 28 and d["type_compat"].count() == 784 and d["sources"].count() == 11


def test_quoted_csv_over_many_blocks(spark, tmp_path):
    """Every cut of the files gives the records that a whole reading gives."""
    import csv

    rnd = random.Random(2)
    value = lambda: "".join(rnd.choice(["a", "b", ",", '"', "\n", "é", " "]) for _ in range(rnd.choice([0, 3, 30, 400])))
    want = []
    for name, columns in (("one", ["id", "text", "best"]), ("two", ["best", "id", "text"])):
        with open(f"{tmp_path}/{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
            w.writerow(columns)
            for i in range(60):
                row = {"id": f"{name}{i}", "text": value(), "best": str(i)}
                w.writerow([row[c] for c in columns])
                want.append((row["id"], row["text"] or None, row["best"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2000", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_quoted_csv(spark, str(tmp_path), positions=True)
            assert sorted((r.id, r.text or None, r.best) for r in got.collect()) == sorted(want), size
            order = [r.id for r in got.where("file_path like '%one.csv'").orderBy("start", "line").collect()]
            assert order == [f"one{i}" for i in range(60)], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_append_opens_no_other_dates(spark, tmp_path):
    def rows(day, n):
        d = spark.createDataFrame([(i, "t", "gdelt_v2", "37UDP0632", datetime(2024, 3, day, 5), datetime(2024, 3, day, 6), f"report {i}") for i in range(n)],
                                  "seq long, theater_id string, source_id string, cell_id string, occurred_start timestamp, occurred_end timestamp, text string")
        return I.with_identity(d)

    log, ledger = f"{tmp_path}/log", f"{tmp_path}/ledger"
    assert sinks.append_observations(rows(1, 5), log, ledger, "seq") == {"ingested": 5, "exact_dup": 0}
    for f in Path(log).rglob("*.parquet"):
        f.write_bytes(b"not a table")
    # the files of another date cannot be read, and nobody tries
    assert sinks.append_observations(rows(2, 4), log, ledger, "seq") == {"ingested": 4, "exact_dup": 0}
    assert sinks.append_observations(rows(2, 6), log, ledger, "seq") == {"ingested": 2, "exact_dup": 4}
    assert spark.read.schema(sinks.LEDGER).parquet(ledger).groupBy("reason").count().collect()[0][:] == ("exact_dup", 4)


def test_detections_are_made_once_and_a_broken_run_is_done_again(spark, tmp_path, monkeypatch):
    from obsweave.operators import detect

    grid = with_cell(spark.createDataFrame([(37.749, 48.1394)], "lon double, lat double"), "lon", "lat").select("cell_id")
    seen = []

    def run(stacks):
        seen.append(sorted(r.cache_key for r in stacks.collect()))
        d = stacks.where("cache_key <> 'empty'")
        day = F.to_timestamp(F.lit("2024-03-01"))
        return d.select("cache_key", F.lit("fire").alias("obs_type"), F.lit("x").alias("label"), F.concat(F.lit("seen at "), "cache_key").alias("text"), F.lit(0.9).alias("self_conf"), F.lit(3).alias("n_pixels"),
                        F.lit(37.749).alias("lon"), F.when(F.col("cache_key") == "far", 10.0).otherwise(48.1394).alias("lat"), F.lit(20).alias("scale_m"), day.alias("stack_start"), day.alias("stack_end"))

    stacks = spark.createDataFrame([("a",), ("b",), ("empty",), ("far",), (None,)], "cache_key string")
    once = lambda s: detect.detect_and_persist(s, run, grid, str(tmp_path), "sentinel1_sar_logratio", "t")
    state = lambda: tuple(spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("log", "ledger", "cache"))

    def dies(*a):
        sinks_commit(*a)
        raise RuntimeError("lost")

    # log, ledger and cache are written, and then the run dies before its keys are
    sinks_commit = sinks.commit_batch
    monkeypatch.setattr(sinks, "commit_batch", dies)
    with pytest.raises(RuntimeError, match="lost"):
        once(stacks)
    assert state() == (2, 1, 2)
    monkeypatch.setattr(sinks, "commit_batch", sinks_commit)
    assert once(stacks) == {"stacks": 4, "detections": 3, "placed": 2, "unplaced": 1}
    assert state() == (2, 1, 2)
    n = len(seen)
    assert once(stacks)["stacks"] == 0 and state() == (2, 1, 2) and len(seen) == n
    assert once(stacks.union(spark.createDataFrame([("new",)], "cache_key string")))["stacks"] == 1 and seen[-1] == ["new"] and state() == (3, 1, 3)
    assert {r.cache_key: r.n_detections for r in spark.read.parquet(f"{tmp_path}/keys").collect()} == {"a": 1, "b": 1, "far": 1, "empty": 0, "new": 1}
