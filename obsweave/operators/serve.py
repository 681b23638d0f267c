"""Read queries over events: lists, cards, queues, ranked feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.operators import assess as A
from obsweave.session import cut

SHOWN_AS_RUMORED = ["single-source", "echo-only", "verification-needed"]  # fixed rule
PAGE_HEAP_ROWS = 10_000     # rows that a task may hold for one page


def list_events(events: DataFrame, status: str | None = None, band: str | None = None, flag: str | None = None, since: str | None = None,
                until: str | None = None, cells: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered events, newest end first. ``cells`` limits to an admin unit or area by semi join."""
    d = events
    if status:
        d = d.where(F.col("status") == status)
    if band:
        d = d.where(F.col("confidence_band") == band)
    if flag:
        d = d.where(F.array_contains("flags", flag))
    if since:
        d = d.where(F.col("occurred_end") >= A.at(since))
    if until:
        d = d.where(F.col("occurred_start") <= A.at(until))
    if cells is not None:
        d = d.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    d = d.orderBy(F.desc_nulls_last("occurred_end"), "event_id")
    if offset:
        d = d.offset(offset)
    return d if limit is None else d.limit(limit)


def attach_geo_context(events: DataFrame, context: DataFrame) -> DataFrame:
    return events.join(context, "cell_id", "left")


def event_count(events: DataFrame) -> DataFrame:
    return events.groupBy("theater_id").agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(F.desc("n"))


def theaters(events: DataFrame) -> DataFrame:
    names = {k: v[0] for k, v in dims.THEATERS.items()}
    return event_count(events).withColumn("label", dims.choose(F.col("theater_id"), names, F.col("theater_id")))


def evidence_trail(members: DataFrame, obs: DataFrame, sources: DataFrame) -> DataFrame:
    """Bridge rows with their record, source label and a 280-character excerpt (the excerpt is the feature)."""
    o = obs.select("obs_id", "source_id", "obs_type", "occurred_start", "occurred_end", "cell_id", F.substring("text", 1, 280).alias("excerpt"))
    s = sources.select("source_id", F.col("label").alias("source_label"), F.col("family_id").alias("family"))
    return members.select("event_id", "obs_id").join(o, "obs_id").join(s, "source_id", "left")


def event_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.orderBy("event_id", F.desc("created_at"), F.desc("review_id"))


def event_detail(events: DataFrame, evidence: DataFrame, context: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per event with its evidence count, context and latest review; rows of evidence stay in their own table."""
    e = evidence.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("family").alias("n_evidence_families"))
    r = reviews.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.max_by("action", F.struct("created_at", "review_id")).alias("last_action"))
    return attach_geo_context(events, context).join(e, "event_id", "left").join(r, "event_id", "left")


def cell_detail(cells: DataFrame, context: DataFrame, events: DataFrame) -> DataFrame:
    n = events.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("occurred_end").alias("last_end"))
    return cells.join(context, "cell_id", "left").join(n, "cell_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def events_in_cell(events: DataFrame, cell: str, limit: int = 50) -> DataFrame:
    return events.where(F.col("cell_id") == cell).orderBy(F.desc("occurred_end"), "event_id").limit(limit)


def list_features(features: DataFrame, kind: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Features of a kind whose bounds (w, s, e, n) overlap the box, with the name from their properties."""
    w, s, e, n = bbox
    f = features.where((F.col("kind") == kind) & (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s))
    return f.withColumn("name", F.get_json_object("properties", "$.name"))


def verify_order() -> list[Column]:
    return [F.desc(F.array_contains("flags", "verification-needed")), F.array_position(F.array(*[F.lit(b) for b in reversed(dims.BANDS)]), F.col("confidence_band")),
            F.asc("confidence"), F.desc_nulls_last("occurred_end"), F.asc("event_id")]


def verify_queue(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy(*verify_order()).limit(limit)


def list_labels(labels: DataFrame, kind: str) -> DataFrame:
    return labels.where(F.col("kind") == kind).orderBy("created_at", "label_id")


def event_assessments(events: DataFrame, assessed: DataFrame, kind: str, limit: int = 25) -> DataFrame:
    cols = [c for c in events.columns if c not in assessed.columns or c == "event_id"]
    return assessed.where(F.col("kind") == kind).join(events.select(*cols), "event_id").orderBy(F.desc("score"), "event_id").limit(limit)


def top_anomalies(assessed: DataFrame, limit: int = 25) -> DataFrame:
    """The strongest anomalies of each theater (of all where none is named), with their rank."""
    w = Window.partitionBy(*(["theater_id"] if "theater_id" in assessed.columns else [F.lit(1)])).orderBy(F.desc("score"), "cell_id", "subkind")
    return assessed.where("kind = 'anomaly'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


INSIGHT_FEEDS = ("significance", "anomaly", "exposure", "gaps")


def insights(assessed: DataFrame, nearest: DataFrame, limit: int = 25) -> dict[str, DataFrame]:
    """The four feeds, each with its best rows, their rank and the nearest place; the cell is the only position."""
    top = A.top_n_per_kind(assessed.withColumn("event_id", F.coalesce("event_id", F.concat_ws(" ", "cell_id", "subkind"))), limit)
    d = top.join(nearest.select("cell_id", F.col("label").alias("place_label")), "cell_id", "left")
    return {kind: d.where(F.col("kind") == kind) for kind in INSIGHT_FEEDS}


def list_rejections(ledger: DataFrame, reason: str | None = None, source: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ledger rows with their payload, by source, reason and payload."""
    d = ledger
    if reason is not None:
        d = d.where(F.col("reason") == reason)
    if source is not None:
        d = d.where(F.col("source_id") == source)
    return page(d, ["source_id", "reason", "raw_payload"], limit, offset)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0, heap_rows: int = PAGE_HEAP_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in this order, whatever their number.

    A short page is a top-k. Top-k sets aside room for the rows asked for in every task, not for those there
    are, so a long page sorts in ranges and counts the rows of the ranges before each one.
    """
    if offset + limit <= heap_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    at = F.monotonically_increasing_id()
    d = cut(df.orderBy(*order).withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at")
    d = d.join(F.broadcast(starts), "_range").where((place >= offset) & (place < offset + limit))
    return d.orderBy("_range", "_at").drop("_range", "_at", "_start")


def list_layer(features: DataFrame, layer: str, bbox: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """A map layer: features of one kind in a box as (feature_id, subkind, name, cell_id), by id; no geometry finer than a cell."""
    d = list_features(features, layer, bbox).select("feature_id", "subkind", "name", "cell_id").orderBy("feature_id")
    return d if limit is None else d.limit(limit)


def display_band(band: Column, flags: Column) -> Column:
    return F.when(F.arrays_overlap(flags, F.lit(SHOWN_AS_RUMORED)), "Rumored").otherwise(band)


def sensor_kind(modality: Column, family: Column) -> Column:
    """Sensor group by words in modality and family, first rule wins."""
    s = F.lower(F.concat_ws(" ", modality, family))
    has = lambda *w: F.greatest(*[F.contains(s, F.lit(x)) for x in w]) if len(w) > 1 else F.contains(s, F.lit(w[0]))
    return (F.when(has("optical"), "optical").when(has("sar", "sentinel1"), "sar").when(has("unosat"), "unosat")
            .when(has("thermal", "firms", "modis"), "thermal").when(has("imagery"), "imagery").otherwise("news"))


def event_provenance(members: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct sensor groups per event."""
    d = members.select("event_id", "obs_id").join(obs.select("obs_id", sensor_kind(F.col("modality"), F.col("source_family_id")).alias("k")), "obs_id")
    return d.groupBy("event_id").agg(F.array_sort(F.collect_set("k")).alias("kinds"))


def band_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(display_band(F.col("confidence_band"), F.col("flags")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def ranked_feed(events: DataFrame, limit: int | None = None) -> DataFrame:
    rank = dims.choose(display_band(F.col("confidence_band"), F.col("flags")), {b: i for i, b in enumerate(dims.BANDS)}, 9)
    d = events.orderBy(rank, F.desc("occurred_start"), "event_id")
    return d if limit is None else d.limit(limit)


def cell_history(events: DataFrame, cell: str) -> DataFrame:
    return events.where(F.col("cell_id") == cell).orderBy("occurred_start", "event_id")
