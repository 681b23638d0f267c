"""Golden corpus, and blocking/scoring against brute force on random boards."""
import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions.cells import with_cell, with_centroid
from obsweave.functions.timegeo import cell_distance_m, interval_gap_s
from obsweave.operators import block as B
from obsweave.operators import evaluate as E
from obsweave.operators import fuse as FU
from obsweave.operators import score as S
from obsweave.operators.components import component_labels, with_component

GOLD = json.loads((Path(__file__).parent / "golden.json").read_text())
OBS_SCHEMA = ("obs_id string, theater_id string, source_id string, source_family_id string, modality string, obs_type string, "
              "occurred_start timestamp, occurred_end timestamp, cell_id string, geom_precision_m double, place_id long, "
              "content_hash string, text string")


def frame(spark, rows):
    cols = [c.split()[0] for c in OBS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], OBS_SCHEMA)


def golden_obs(spark):
    rows = [{**o, "occurred_start": datetime.fromisoformat(o["occurred_start"]),
             "occurred_end": datetime.fromisoformat(o["occurred_end"])} for o in GOLD["observations"]]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def golden(spark):
    verdicts = spark.createDataFrame(GOLD["verdicts"], "pair_key string, same boolean, confidence double")
    return FU.fuse(golden_obs(spark), verdicts)


def test_golden_digest_and_counts(spark, golden):
    assert FU.digest_sha256(FU.published_events(golden.members, golden.events)) == "bf11cd6b257d83cb96ab420428319638062fbab5e92605018fed899b9293c5fb"
    c = FU.run_counters(golden.grouped, golden.decisions).first()
    assert (c.groups, c.pairs_seen, c.cache_hits, c.degraded_keep_separate) == (9, 10, 7, 0)
    a = FU.coverage_audit(golden_obs(spark), golden.members, golden.rejections).first()
    assert a.ok and a.input == 18 and a.in_events == 18
    assert {r.confidence_band: r.n_events for r in FU.fusion_summary(golden.events).collect()} == {"High": 5, "Rumored": 6}


def test_golden_scores(golden):
    got = {(r.obs_a, r.obs_b): (r.p, r.band) for r in golden.scored.collect()}
    want = {("INC-01.a", "INC-01.b"): (0.677246, "gray"), ("INC-02.a", "INC-02.b"): (0.902784, "same"),
            ("INC-02.a", "INC-02.c"): (0.790934, "gray"), ("INC-02.b", "INC-02.c"): (0.867557, "same"),
            ("INC-04.a", "INC-04.b"): (0.594283, "gray"), ("INC-05.a", "INC-05.b"): (0.577614, "gray"),
            ("INC-06.a", "INC-06.b"): (0.593536, "gray"), ("INC-08A.a", "INC-08B.a"): (0.429992, "gray"),
            ("INC-09.a", "INC-09.b"): (0.707823, "gray")}
    assert got == want


def test_replay_and_missing_model(spark, golden):
    down = FU.fuse(golden_obs(spark), None)
    a = FU.coverage_audit(golden_obs(spark), down.members, down.rejections).first()
    assert a.ok and down.events.count() == 16
    assert down.events.where("array_contains(flags, 'verification-needed')").count() > 0
    assert FU.replay_check(golden.events, golden.events).first().digest_equal
    assert not FU.replay_check(golden.events, down.events).first().digest_equal


def board(seed, n=60):
    rnd = random.Random(seed)
    types = ["strike", "explosion", "fire", "troop_move", "building_damaged"]
    fams = ["ucdp", "gdelt", "unosat"]
    t0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
    words = ["market", "bridge", "station", "heavy", "shelling", "north", "depot", "fire", "smoke", "12", "40"]
    rows = []
    for i in range(n):
        start = t0 + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        rows.append(dict(obs_id=f"o{i:03d}", theater_id="t", source_id="gdelt_v2", source_family_id=rnd.choice(fams), modality="text",
                         obs_type=rnd.choice(types), occurred_start=start, occurred_end=start + timedelta(minutes=rnd.randrange(1, 600)),
                         geom_precision_m=float(rnd.choice([100, 700, 3000, 20000])), place_id=rnd.randrange(4) if rnd.random() < 0.25 else None,
                         content_hash=f"h{i:03d}", text=" ".join(rnd.choices(words, k=5)),
                         lon=36.8 + rnd.random() * 0.4, lat=48.0 + rnd.random() * 0.4))
    return rows


def placed(spark, rows):
    geo = spark.createDataFrame([(r["obs_id"], r["lon"], r["lat"]) for r in rows], "obs_id string, lon double, lat double")
    return frame(spark, rows).drop("cell_id").join(with_cell(geo, "lon", "lat").select("obs_id", "cell_id"), "obs_id")


def brute_links(obs):
    d = with_centroid(B.with_span(obs))
    a, b = d.alias("a"), d.alias("b")
    x, y = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    gap = interval_gap_s(x("start_us"), x("end_us"), y("start_us"), y("end_us"))
    near = cell_distance_m(x("cell_id"), y("cell_id"), x("lon"), x("lat"), y("lon"), y("lat")) <= F.greatest(x("radius_m"), y("radius_m"))
    return a.join(b, (x("obs_id") < y("obs_id")) & (gap * 1e6 <= F.greatest(x("window_us"), y("window_us")))
                  & (near | F.coalesce(x("place_id") == y("place_id"), F.lit(False)))
                  & (dims.type_compat(x("obs_type"), y("obs_type")) > 0)).select(x("obs_id").alias("a"), y("obs_id").alias("b"))


@pytest.mark.parametrize("seed,n", [(2, 60), (4, 120)])
def test_block_equals_brute_force(spark, seed, n):
    obs = placed(spark, board(seed, n)).cache()
    got, want = {}, {}
    for r in B.block(obs).select("obs_id", "group_id", "group_rows").collect():
        got.setdefault(r.group_id, set()).add(r.obs_id)
        assert r.group_rows >= 1
    for r in with_component(obs.select("obs_id"), brute_links(obs), "obs_id").collect():
        want.setdefault(r.component, set()).add(r.obs_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(r.group_rows == len(got[r.group_id]) for r in B.block(obs).select("group_id", "group_rows").distinct().collect())


@pytest.mark.parametrize("seed", [5])
def test_scored_pairs_equal_brute_force(spark, seed, monkeypatch):
    grouped = FU.group(placed(spark, board(seed, 150)))
    want = S.score_pairs(grouped.alias("a").join(grouped.alias("b"), F.expr("a.group_id = b.group_id and a.obs_id < b.obs_id")))
    want = {tuple(r) for r in want.where("band <> 'different'").select("obs_a", "obs_b", "p", "band", "s_text").collect()}
    monkeypatch.setattr("obsweave.operators.nearby.HOT_BUCKET_ROWS", 5)
    for small in (256, 0):   # plain and bucketed joins
        rows = S.scored_pairs(grouped, small).where("band <> 'different'").select("obs_a", "obs_b", "p", "band", "s_text").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_one_id_formula_and_members_in_the_bridge(spark, golden):
    import hashlib
    assert "created_from_obs" not in golden.events.columns
    rows = {}
    for r in E.predicted_partition(golden.members, golden.events).collect():
        rows.setdefault(r.event_id, []).append(r.obs_id)
    assert sum(map(len, rows.values())) == 18
    for e in golden.events.collect():
        h = [hashlib.sha256(o.encode()).hexdigest() for o in rows[e.event_id]]
        want = f"{len(h)}:{sum(int(x[:15], 16) for x in h)}:{sum(int(x[16:31], 16) for x in h)}"
        ident = hashlib.sha256(f"{e.event_type}|{e.cell_id}|{want}".encode()).hexdigest()
        assert e.member_digest == want and e.event_id.replace("-", "") == ident[:32]


def test_theaters_stay_apart(spark):
    rows = board(7, 40)
    both = rows + [{**r, "obs_id": "x" + r["obs_id"], "theater_id": "u"} for r in rows]
    got = {}
    for r in B.block(placed(spark, both)).select("obs_id", "theater_id", "group_id").collect():
        got.setdefault(r.group_id, set()).add(r.theater_id)
    assert all(len(v) == 1 for v in got.values())
    one = {r.group_id for r in B.block(placed(spark, rows)).select("group_id").collect()}
    assert len(got) == 2 * len(one)
    run = FU.fuse(placed(spark, both))
    assert {r.theater_id for r in run.events.collect()} == {"t", "u"}


def test_unknown_precision_is_a_cell(spark):
    rows = board(3, 3)
    for r, p in zip(rows, (None, 0.0, 300.0)):
        r["geom_precision_m"] = p
    assert {r.obs_id: r.geom_precision_m for r in FU.with_precision(frame(spark, rows)).collect()} == {"o000": 1000.0, "o001": 1000.0, "o002": 300.0}


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_of_paths_rings_and_hubs(spark, small):
    """Both ways to the end: one last contraction, and steps over the whole table."""
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(3000 + rnd.randrange(400), 3000 + rnd.randrange(400)) for _ in range(250)] + [(5000, 5000), (5001, 5001)]
    rnd.shuffle(edges)
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    assert {r.id: r.label for r in component_labels(df, small_edges=small).collect()} == {x: v for x, v in label.items() if v != x}
    words = df.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a < 1000")
    assert component_labels(words, small_edges=small).select("label").distinct().collect()[0].label == "0"
    assert component_labels(df.where("a = 5000"), small_edges=small).count() == 0


def test_a_failing_pair_stays_apart_and_the_rest_is_kept(spark):
    def model(rows):
        if any(r["pair_key"] == "bad" for r in rows):
            raise RuntimeError("no answer")
        return ['{"same": true, "confidence": 0.9}' if r["pair_key"] != "odd" else '{"same": "maybe"}' for r in rows]

    gray = spark.createDataFrame([("a", "b", "good"), ("c", "d", "bad"), ("e", "f", "odd"), ("g", "h", "fine")], "obs_a string, obs_b string, pair_key string").coalesce(1)
    got = {r.pair_key: (r.same, r.source, r.needs_check) for r in FU.adjudicate(gray, None, FU.decide_by_model(model)).collect()}
    apart = (False, "degraded_keep_separate", True)
    assert got == {"good": (True, "verdict", False), "fine": (True, "verdict", False), "bad": apart, "odd": apart}


def test_summary_has_totals_and_dropped_records(spark):
    ev = spark.createDataFrame([("High", 3), ("High", 1), ("Low", 2)], "confidence_band string, n_sources int")
    got = {r.confidence_band: (r.n_events, r.n_obs) for r in FU.fusion_summary(ev, spark.createDataFrame([("x",)], "reason string")).collect()}
    assert got == {"High": (2, 4), "Low": (1, 2), "all": (3, 6), "dropped": (0, 1)}
