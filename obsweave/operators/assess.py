"""Scoring of events: significance, anomalies per cell, exposure, collection gaps, attention per area.

``now`` is always a parameter, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.operators.pyramid import nearest

# Fixed values of the assessment.
RECENCY_TAU_DAYS, RECENCY_FLOOR, SINGLE_SOURCE_FACTOR = 10.0, 0.3, 0.5
MIN_SIGNIFICANCE, TOP_SIGNIFICANCE, TOP_PER_KIND = 0.08, 250, 80
SPIKE_DAYS, SPIKE_MIN, SPIKE_RATIO, ESCALATION_MIN = 10.0, 3, 2.0, 0.6
EXPOSURE_RADIUS_KM, EXPOSURE_MIN = 15.0, 0.12
GAP_MIN_SEVERITY, GAP_DAYS, GAP_MIN = 0.75, 120.0, 0.2
ATTENTION_DAYS, ESCALATE_RATIO, QUIET_RATIO, MIN_NEW = 45.0, 1.5, 0.6, 3
IN_TOWN_KM, NEAR_KM = 4.0, 18.0


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def age_days(start: Column, now: str) -> Column:
    return (F.unix_micros(at(now)) - F.unix_micros(start)) / 86400e6


def recency(start: Column, now: str) -> Column:
    return F.when(start.isNotNull(), F.exp(-F.greatest(F.lit(0.0), age_days(start, now)) / RECENCY_TAU_DAYS))


def recency_factor(start: Column, now: str) -> Column:
    return RECENCY_FLOOR + (1 - RECENCY_FLOOR) * recency(start, now)


def spoken(t: Column) -> Column:
    return F.replace(t, F.lit("_"), F.lit(" "))


def cell_type_counts(events: DataFrame) -> DataFrame:
    """Number of events per cell and type (bounded by the taxonomy per cell)."""
    return events.groupBy("cell_id", "event_type").agg(F.count(F.lit(1)).alias("n_same"))


def load_events_enriched(events: DataFrame, centroids: DataFrame, context: DataFrame) -> DataFrame:
    return events.join(centroids.select("cell_id", "lon", "lat"), "cell_id", "left").join(context, "cell_id", "left")


def significance(events: DataFrame, now: str) -> DataFrame:
    d = events.join(cell_type_counts(events), ["cell_id", "event_type"])
    sev, fams = dims.severity(F.col("event_type")), F.coalesce("n_independent_families", F.lit(0))
    d = (d.withColumn("severity", sev).withColumn("raw_recency", recency(F.col("occurred_start"), now))
         .withColumn("recency", RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.col("raw_recency"))
         .withColumn("novelty", 1 / F.greatest(F.col("n_same"), F.lit(1)))
         .withColumn("corroboration", F.when(fams >= 2, 1.0).otherwise(SINGLE_SOURCE_FACTOR)))
    nov, rec = F.col("novelty"), F.col("raw_recency")
    words = F.concat_ws(
        "; ", F.concat(F.when(F.col("severity") >= 0.75, "high").when(F.col("severity") >= 0.5, "moderate").otherwise("low"),
                       F.lit("-severity "), spoken(F.col("event_type"))),
        F.when(fams >= 2, "confirmed by several sources").otherwise("single-source (unconfirmed)"),
        F.when(rec >= 0.7, "very recent").when(rec >= 0.3, "recent").otherwise("older"),
        F.when(nov >= 0.99, "first of its kind in this area").when(nov <= 0.34, "one of many similar here"))
    score = F.col("severity") * F.coalesce("confidence", F.lit(0.0)) * F.col("recency") * nov * F.col("corroboration")
    return d.select(*_theater(d), "event_id", "cell_id", "event_type", F.lit("significance").alias("kind"), F.round(score, 4).alias("score"),
                    F.struct(*[F.round(F.col(c), 3).alias(c) for c in ("severity", "confidence", "recency", "novelty", "corroboration")]).alias("components"),
                    F.concat(words, F.lit(".")).alias("rationale"))


def _theater(df: DataFrame) -> list[str]:
    return ["theater_id"] if "theater_id" in df.columns else []


def top_significance(scored: DataFrame, n: int = TOP_SIGNIFICANCE) -> DataFrame:
    """Best rows of each theater (of all rows where they name none)."""
    d = scored.where(F.col("score") >= MIN_SIGNIFICANCE)
    w = Window.partitionBy(*(_theater(d) or [F.lit(1)])).orderBy(F.desc("score"), "event_id")
    return d.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def cell_anomalies(events: DataFrame, now: str) -> DataFrame:
    """Activity spikes and escalations per cell, from counts per cell and type."""
    cut_ = at(now) - F.make_dt_interval(F.lit(int(SPIKE_DAYS)))
    recent = F.col("occurred_start") >= cut_
    per = events.groupBy("cell_id", "event_type").agg(F.count_if(recent).alias("r"), F.count_if(~recent).alias("p")).withColumn(
        "sev", dims.severity(F.col("event_type")))
    fresh = (F.col("r") > 0) & (F.col("p") == 0)
    cell = per.groupBy("cell_id").agg(
        F.sum("r").alias("n_recent"), F.sum("p").alias("n_prior"),
        F.max(F.when(F.col("p") > 0, F.col("sev"))).alias("prior_worst"),
        F.array_sort(F.collect_set(F.when(F.col("p") > 0, spoken(F.col("event_type"))))).alias("prior_types"),
        # worst new type; the name settles ties
        F.max(F.when(fresh, F.col("sev"))).alias("new_sev"),
        F.min_by("event_type", F.when(fresh, F.struct(-F.col("sev"), F.col("event_type")))).alias("new_type"))
    spike = cell.where(F.col("n_recent") >= SPIKE_MIN).select(
        "cell_id", F.lit("anomaly").alias("kind"), F.lit("activity_spike").alias("subkind"),
        F.round(F.least(F.lit(1.0), F.col("n_recent") / (SPIKE_MIN * SPIKE_RATIO)), 4).alias("score"),
        "n_recent", F.lit(None).cast("string").alias("new_type"),
        F.concat(F.col("n_recent").cast("string"), F.lit(f" events here in the last {int(SPIKE_DAYS)} days — a flare-up.")).alias("rationale"))
    esc = cell.where((F.col("n_prior") > 0) & (F.col("new_sev") >= ESCALATION_MIN) & (F.col("new_sev") > F.col("prior_worst"))).select(
        "cell_id", F.lit("anomaly").alias("kind"), F.lit("escalation").alias("subkind"), F.round("new_sev", 4).alias("score"),
        "n_recent", "new_type", F.concat(F.lit("new "), spoken(F.col("new_type")), F.lit(" where only "), F.array_join("prior_types", ", "),
                                         F.lit(" had been seen — possible escalation.")).alias("rationale"))
    return spike.unionByName(esc)


def nearest_place(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Nearest place of each distinct cell (cell_id, lon, lat): name, label and distance (`pyramid.nearest`)."""
    label = (F.when(F.col("km") <= IN_TOWN_KM, F.col("name")).when(F.col("km") <= NEAR_KM, F.concat(F.lit("near "), "name"))
             .otherwise(F.concat(F.lit("rural area near "), "name")))
    return nearest(cells, places).select("cell_id", "name", label.alias("label"), "km", F.round("km", 1).alias("distance_km"))


def exposure(events: DataFrame, nearest: DataFrame, builtup: DataFrame | None = None) -> DataFrame:
    """Events near settlements; ``builtup`` is (cell_id, builtup_pct)."""
    d = events.join(nearest.where(F.col("km") <= EXPOSURE_RADIUS_KM), "cell_id")
    d = d.join(builtup, "cell_id", "left") if builtup is not None else d.withColumn("builtup_pct", F.lit(None).cast("double"))
    near = 1 - F.col("km") / EXPOSURE_RADIUS_KM
    score = F.round(dims.severity(F.col("event_type")) * F.greatest(near, F.coalesce("builtup_pct", near)), 4)
    where = F.when(F.col("km") < 2.0, "in").otherwise(F.concat(F.col("distance_km").cast("string"), F.lit(" km from")))
    return d.withColumn("score", score).where(F.col("score") >= EXPOSURE_MIN).select(
        *_theater(d), "event_id", "cell_id", F.lit("exposure").alias("kind"), "score", F.col("name").alias("settlement"), "distance_km",
        F.concat_ws(" ", spoken(F.col("event_type")), where, F.concat("name", F.lit(" — populated area exposed."))).alias("rationale"))


def collection_gap(events: DataFrame, now: str) -> DataFrame:
    sev = dims.severity(F.col("event_type"))
    score = F.round(sev * recency_factor(F.col("occurred_start"), now), 4)
    return events.where((F.coalesce("n_independent_families", F.lit(0)) < 2) & (sev >= GAP_MIN_SEVERITY) & F.col("occurred_start").isNotNull()
                        & (age_days(F.col("occurred_start"), now) <= GAP_DAYS)).withColumn("score", score).where(F.col("score") >= GAP_MIN).select(
        *_theater(events), "event_id", "cell_id", F.lit("gaps").alias("kind"), "score",
        F.concat(F.lit("recent "), spoken(F.col("event_type")), F.lit(" from a single source — needs a second independent source to confirm.")).alias("rationale"))


def top_n_per_kind(assessments: DataFrame, n: int = TOP_PER_KIND) -> DataFrame:
    """Best rows per theater and kind; the rank filter lets Spark keep only n rows of each per map task."""
    w = Window.partitionBy(*_theater(assessments), "kind").orderBy(F.desc("score"), "event_id")
    return assessments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def assess(events: DataFrame, now: str, nearest: DataFrame | None = None, builtup: DataFrame | None = None) -> DataFrame:
    """All assessment rows of a run in one frame."""
    cols = ["event_id", "cell_id", "kind", "subkind", "score", "rationale"]
    none = F.lit(None).cast("string")
    parts = [top_significance(significance(events, now)).withColumn("subkind", none),
             cell_anomalies(events, now).withColumn("event_id", none),
             top_n_per_kind(collection_gap(events, now)).withColumn("subkind", none)]
    if nearest is not None:
        parts.append(top_n_per_kind(exposure(events, nearest, builtup)).withColumn("subkind", none))
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out.withColumn("as_of", at(now))


def attention(areas: DataFrame, area_events: DataFrame, area_anomalies: DataFrame | None, now: str, key: str = "area") -> DataFrame:
    """Status of every area at once: (area, event rows) and (area, subkind) -> one row per row of ``areas``.

    An area without events stays, with zeros. No anomalies: the status comes from the trend alone.
    """
    recent_cut = at(now) - F.make_dt_interval(F.lit(int(ATTENTION_DAYS)))
    prior_cut = at(now) - F.make_dt_interval(F.lit(int(2 * ATTENTION_DAYS)))
    t = F.col("occurred_start")
    e = area_events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(t >= recent_cut).alias("recent"),
                                     F.count_if((t < recent_cut) & (t >= prior_cut)).alias("prior"),
                                     F.count_if(F.col("n_independent_families") >= 2).alias("confirmed"))
    d = areas.select(key).distinct().join(e, key, "left").na.fill(0, ["n_events", "recent", "prior", "confirmed"])
    if area_anomalies is None:
        d = d.withColumn("has_escalation", F.lit(False)).withColumn("has_spike", F.lit(False))
    else:
        a = area_anomalies.groupBy(key).agg(F.max(F.col("subkind") == "escalation").alias("has_escalation"),
                                            F.max(F.col("subkind") == "activity_spike").alias("has_spike"))
        d = d.join(a, key, "left").na.fill(False, ["has_escalation", "has_spike"])
    r, p = F.col("recent"), F.col("prior")
    status = (F.when(F.col("has_escalation") | ((p > 0) & (r >= p * ESCALATE_RATIO)) | ((p == 0) & (r >= MIN_NEW)), "escalating")
              .when((p > 0) & (r <= p * QUIET_RATIO), "quieting").otherwise("steady"))
    trend = F.when(p > 0, F.round(r / F.nullif(p, F.lit(0)), 2)).otherwise(r.cast("double"))
    return d.withColumn("status", status).withColumn("trend_score", trend)


def attention_order() -> list[Column]:
    rank = F.when(F.col("status") == "escalating", 0).when(F.col("status") == "quieting", 2).otherwise(1)
    return [rank, F.desc("recent"), F.desc("n_events"), F.col("area")]
