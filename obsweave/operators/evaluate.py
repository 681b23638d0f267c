"""Evaluation against labelled truth: pair counts without listing pairs, recall, bands, damage cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions.cells import with_cell, with_centroid
from obsweave.functions.timegeo import cell_distance_m, in_bbox
from obsweave.operators.nearby import SPACE_KEYS, space_keys
from obsweave.operators.score import band_of

# Gate targets and damage grades that count as truth.
GATE = {"event_recall": 0.95, "pairwise_recall": 0.90, "over_merge": 0.0, "band_correctness": 1.0}
TRUTH_GRADES = (2, 4)


def predicted_partition(members: DataFrame, events: DataFrame) -> DataFrame:
    """Event of every record, from the bridge, so events of any size keep all their members."""
    return members.select("component", "obs_id").join(events.select("component", "event_id"), "component").select("event_id", "obs_id")


def incident_members(truth: DataFrame) -> DataFrame:
    return truth.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long")


def contingency(members: DataFrame, truth: DataFrame) -> DataFrame:
    """(event_id, incident_id, n) over records that have a label."""
    return truth.join(members, "obs_id").groupBy("event_id", "incident_id").agg(F.count(F.lit(1)).alias("n"))


def pairwise_pr(members: DataFrame, truth: DataFrame) -> DataFrame:
    """True/false positives and negatives over all record pairs, from table margins."""
    c = contingency(members, truth)
    one = F.lit(1).alias("_k")
    both = c.agg(_pairs(F.col("n")).alias("tp")).select(one, "tp")
    pred = c.groupBy("event_id").agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("pred")).select(one, "pred")
    true = c.groupBy("incident_id").agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("true")).select(one, "true")
    all_ = c.agg(F.sum("n").alias("n")).select(one, F.coalesce(F.expr("n * (n - 1) div 2"), F.lit(0)).alias("all"))
    d = both.join(pred, "_k").join(true, "_k").join(all_, "_k")
    ratio = lambda a, b: F.round(F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(1.0), 6)
    return d.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"),
                    (F.col("all") - F.col("pred") - F.col("true") + F.col("tp")).alias("tn"),
                    ratio(F.col("tp"), F.col("pred")).alias("precision"), ratio(F.col("tp"), F.col("true")).alias("recall"))


def incident_outcome(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Per incident: events that hold its records, records without an event, and the event if there is one."""
    return truth.join(members, "obs_id", "left").groupBy("incident_id").agg(
        F.countDistinct("event_id").alias("n_events"), F.count_if(F.col("event_id").isNull()).alias("n_missing"), F.min("event_id").alias("event_id"))


def event_recall(members: DataFrame, truth: DataFrame) -> DataFrame:
    hit = (F.col("n_events") == 1) & (F.col("n_missing") == 0)
    return incident_outcome(members, truth).agg(F.count_if(hit).alias("recovered"), F.count(F.lit(1)).alias("incidents")).withColumn(
        "event_recall", F.round(F.col("recovered") / F.col("incidents"), 6))


def merge_rates(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of incidents split over events, and of events that mix incidents."""
    frag = incident_outcome(members, truth).agg(F.round(F.avg((F.col("n_events") > 1).cast("int")), 6).alias("fragmentation")).withColumn("_k", F.lit(1))
    mixed = contingency(members, truth).groupBy("event_id").agg(F.count(F.lit(1)).alias("k")).agg(
        F.round(F.avg((F.col("k") > 1).cast("int")), 6).alias("over_merge")).withColumn("_k", F.lit(1))
    return frag.join(mixed, "_k").drop("_k")


def band_correctness(members: DataFrame, truth: DataFrame, events: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and actual band of recovered incidents; ``expected`` is (incident_id, band)."""
    rec = incident_outcome(members, truth).where("n_events = 1 and n_missing = 0")
    d = rec.join(expected, "incident_id").join(events.select("event_id", "confidence_band"), "event_id")
    return d.select("incident_id", "band", F.col("confidence_band").alias("got"), (F.col("band") == F.col("confidence_band")).alias("ok"))


def echo_test(members: DataFrame, echo: DataFrame, events: DataFrame) -> DataFrame:
    """Echo groups (echo_id, obs_id) must form one single-family Rumored event."""
    g = echo.join(members, "obs_id", "left").groupBy("echo_id").agg(F.countDistinct("event_id").alias("k"), F.min("event_id").alias("event_id"))
    d = g.join(events.select("event_id", "n_independent_families", "confidence_band"), "event_id", "left")
    return d.select("echo_id", ((F.col("k") == 1) & (F.col("n_independent_families") == 1) & (F.col("confidence_band") == "Rumored")).alias("ok"))


def must_not_merge(members: DataFrame, truth: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Forbidden incident pairs (incident_a, incident_b) that share an event."""
    c = contingency(members, truth)
    a, b = (c.select("event_id", F.col("incident_id").alias(f"incident_{k}")) for k in "ab")
    return forbidden.join(a, "incident_a").join(b, ["event_id", "incident_b"]).select("incident_a", "incident_b", "event_id").distinct()


def gate_report(members: DataFrame, truth: DataFrame, events: DataFrame, expected: DataFrame, echo: DataFrame, forbidden: DataFrame,
                coverage: DataFrame, replay: DataFrame) -> DataFrame:
    """One row with every check of the gate and an overall flag."""
    k = lambda df: df.withColumn("_k", F.lit(1))
    d = k(event_recall(members, truth)).join(k(pairwise_pr(members, truth)), "_k").join(k(merge_rates(members, truth)), "_k")
    d = d.join(k(band_correctness(members, truth, events, expected).agg(F.coalesce(F.avg(F.col("ok").cast("int")), F.lit(1.0)).alias("band_correctness"))), "_k")
    d = d.join(k(echo_test(members, echo, events).agg(F.coalesce(F.min("ok"), F.lit(True)).alias("echo_ok"))), "_k")
    d = d.join(k(must_not_merge(members, truth, forbidden).agg(F.count(F.lit(1)).alias("forbidden_merges"))), "_k")
    d = d.join(k(coverage.select(F.col("ok").alias("no_silent_drop"))), "_k").join(k(replay.select("digest_equal")), "_k").drop("_k")
    ok = ((F.col("event_recall") >= GATE["event_recall"]) & (F.col("recall") >= GATE["pairwise_recall"]) & (F.col("over_merge") <= GATE["over_merge"])
          & (F.col("band_correctness") >= GATE["band_correctness"]) & F.col("echo_ok") & (F.col("forbidden_merges") == 0) & F.col("no_silent_drop") & F.col("digest_equal"))
    return d.withColumn("passed", ok)


# ------------------------------------------------------------------ damage cells
def truth_cells(points: DataFrame, bbox: tuple[float, float, float, float], grades: tuple[int, int] = TRUTH_GRADES) -> DataFrame:
    """Damage points (lon, lat, damage, city) -> per cell: worst grade, count, cities and counts by grade."""
    p = points.where(F.col("damage").between(*grades) & in_bbox(F.col("lon"), F.col("lat"), bbox))
    d = with_cell(p, "lon", "lat").where("cell_id is not null")
    lo, hi = grades
    return d.groupBy("cell_id").agg(F.max("damage").alias("worst"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("city")).alias("cities"),
                                    *[F.count_if(F.col("damage") == g).alias(f"grade_{g}") for g in range(lo, hi + 1)])


def matched_cells(detected: DataFrame, truth: DataFrame, buffer_m: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(detected cells that hit, truth cells that are hit). An exact hit does not also match neighbours."""
    exact = detected.select("cell_id").join(truth.select("cell_id"), "cell_id", "left_semi")
    if buffer_m <= 0:
        return exact, exact
    rest = with_centroid(detected.select("cell_id").join(exact, "cell_id", "left_anti"))
    key = lambda df, wide: space_keys(df.withColumn("lvl", F.lit(0)), "lon", "lat", "lvl", [buffer_m], wide, any_tier=False)
    a, b = key(rest, True).alias("a"), key(with_centroid(truth.select("cell_id")), False).alias("b")
    cond = F.lit(True)
    for k in SPACE_KEYS:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    dist = cell_distance_m(F.col("a.cell_id"), F.col("b.cell_id"), F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    near = a.join(b, cond & (dist <= buffer_m)).select(F.col("a.cell_id").alias("d"), F.col("b.cell_id").alias("t"))
    return (exact.unionByName(near.select(F.col("d").alias("cell_id"))).distinct(), exact.unionByName(near.select(F.col("t").alias("cell_id"))).distinct())


def score_cells(detected: DataFrame, truth: DataFrame, buffer_m: float = 0.0) -> DataFrame:
    """Precision, recall and F1 of detected cells against truth cells."""
    det, tru = detected.select("cell_id").distinct(), truth.select("cell_id").distinct()
    hd, ht = matched_cells(det, tru, buffer_m)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    d = n(det, "n_detected").join(n(tru, "n_truth"), "_k").join(n(hd, "true_positives"), "_k").join(n(ht, "matched_truth"), "_k").drop("_k")
    p = F.when(F.col("n_detected") > 0, F.col("true_positives") / F.nullif("n_detected", F.lit(0))).otherwise(0.0)
    r = F.when(F.col("n_truth") > 0, F.col("matched_truth") / F.nullif("n_truth", F.lit(0))).otherwise(0.0)
    d = d.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0))).otherwise(0.0)
    return d.select("n_detected", "n_truth", "true_positives", (F.col("n_detected") - F.col("true_positives")).alias("false_positives"), "matched_truth",
                    F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def recall_by(truth_rows: DataFrame, matched: DataFrame, by: str) -> DataFrame:
    """Recall within groups of truth cells; ``truth_rows`` is (cell_id, by), one row per cell and group value."""
    hit = matched.select("cell_id").distinct().withColumn("hit", F.lit(1))
    d = truth_rows.select("cell_id", F.coalesce(F.col(by).cast("string"), F.lit("(unknown)")).alias(by)).distinct()
    return d.join(hit, "cell_id", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_matched")).withColumn(
        "recall", F.round(F.col("n_matched") / F.col("n_truth"), 4))


def parameter_sweep(clusters: DataFrame, truth: DataFrame, thresholds: list[float], min_px: list[int]) -> DataFrame:
    """Score of every (threshold, min size) setting in one job; a setting without a detection has zeros. ``clusters`` is (threshold, cell_id, n_pixels)."""
    c = clusters.where(F.col("threshold").isin(thresholds)).groupBy("threshold", "cell_id").agg(F.max("n_pixels").alias("px"))
    c = c.select("threshold", "cell_id", F.explode(F.filter(F.lit([int(m) for m in min_px]), lambda m: m <= F.col("px"))).alias("min_px"))
    hit = truth.select("cell_id").distinct().withColumn("hit", F.lit(1))
    found = c.join(hit, "cell_id", "left").groupBy("threshold", "min_px").agg(F.count(F.lit(1)).alias("n_detected"), F.count("hit").alias("true_positives"))
    settings = clusters.sparkSession.createDataFrame([(float(t), int(m)) for t in thresholds for m in min_px], "threshold double, min_px int")
    d = settings.join(found, ["threshold", "min_px"], "left").na.fill(0, ["n_detected", "true_positives"])
    n = truth.select(F.countDistinct("cell_id").alias("n")).scalar()
    share = lambda of: F.round(F.when(of > 0, F.col("true_positives") / F.nullif(of, F.lit(0))).otherwise(0.0), 4)
    return d.withColumn("precision", share(F.col("n_detected"))).withColumn("recall", share(n))


# ------------------------------------------------------------------ thresholds and fixtures
def rethreshold(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Effect of other thresholds on pairs with ``p`` and the truth flag ``same``."""
    b = band_of(F.col("p"), low, high)
    d = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(b == "gray").alias("gray"), F.count_if(b == "same").alias("merged"),
                  F.count_if((b == "same") & F.col("same")).alias("merged_right"), F.count_if(F.col("same")).alias("truly_same"))
    r = lambda a, c: F.round(F.when(F.col(c) > 0, F.col(a) / F.nullif(c, F.lit(0))).otherwise(1.0), 4)
    return d.withColumn("gray_share", F.round(F.when(F.col("pairs") > 0, F.col("gray") / F.nullif("pairs", F.lit(0))).otherwise(0.0), 4)).withColumn(
        "precision", r("merged_right", "merged")).withColumn("recall", r("merged_right", "truly_same"))


def histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    return pairs.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fusion_snapshot(scored: DataFrame, truth: DataFrame, context: DataFrame, obs: DataFrame) -> DataFrame:
    """Scored pairs with the truth of both records and their cells' context."""
    side = lambda x: (obs.select(F.col("obs_id").alias(f"obs_{x}"), "cell_id").join(truth.select(F.col("obs_id").alias(f"obs_{x}"), F.col("incident_id").alias(f"incident_{x}")), f"obs_{x}", "left")
                      .join(context.select("cell_id", F.col("landcover_label").alias(f"landcover_{x}")), "cell_id", "left").withColumnRenamed("cell_id", f"cell_{x}"))
    return scored.join(side("a"), "obs_a").join(side("b"), "obs_b").withColumn("same", F.col("incident_a") == F.col("incident_b"))


def expand_incidents(incidents: DataFrame) -> DataFrame:
    """Authored incidents (id, observations array) -> one row per record with its incident."""
    return incidents.select(F.col("id").alias("incident_id"), F.explode("observations").alias("o")).select("incident_id", F.concat_ws(".", "incident_id", "o.ref").alias("obs_id"), "o.*")


def pair_diagnostics(snapshot: DataFrame) -> DataFrame:
    """Pairs whose score contradicts the truth."""
    return snapshot.where("(same and band = 'different') or (not same and band = 'same')").withColumn("problem", F.when(F.col("same"), "missed").otherwise("false_merge"))


def detection_cells(obs: DataFrame) -> DataFrame:
    return obs.where("modality = 'imagery'").select("cell_id").distinct()


def incident_labels_to_spec(labels: DataFrame) -> DataFrame:
    """Latest label per incident."""
    return labels.groupBy("incident_id").agg(F.max_by(F.struct("band", "flags"), F.struct("created_at", "label_id")).alias("v")).select("incident_id", "v.*")

