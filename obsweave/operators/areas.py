"""Areas: admin hierarchy, user areas, rollups, area summaries. Every operator handles all areas at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.functions.model_calls import ask_rows
from obsweave.operators import assess as A
from obsweave.operators.grid import terrain_profile
from obsweave.operators.polygons import cells_of_shapes

# Sensor names and band order of the summaries.
SENSOR_NAMES = {"ucdp": "news/reports", "gdelt": "news/reports", "nasa_firms": "thermal", "nasa_modis": "thermal",
                "unosat": "damage assessment", "copernicus_sar": "satellite radar", "copernicus_optical": "satellite optical"}
BAND_RANK = {"High": 0, "Medium": 1, "Low": 2}
ADMIN_COLUMN = {1: "admin1_id", 2: "admin2_id", 3: "admin3_id"}


def area_cells(context: DataFrame, aoi_cells: DataFrame | None = None) -> DataFrame:
    """(area, cell_id) of every area: ``admin:<id>`` from the cell context, ``aoi:<id>`` from user areas."""
    ids = F.array_compact(F.array(*[F.col(c) for c in ADMIN_COLUMN.values()]))
    d = context.select(F.explode(ids).alias("id"), "cell_id").select(F.concat(F.lit("admin:"), "id").alias("area"), "cell_id")
    if aoi_cells is not None:
        d = d.unionByName(aoi_cells.select(F.concat(F.lit("aoi:"), F.col("aoi_id").cast("string")).alias("area"), "cell_id"))
    return d.distinct()


def rollup(units: DataFrame, context: DataFrame, events: DataFrame, level: int, parent: str | None = None, until: str | None = None) -> DataFrame:
    """Event counts per admin unit; units without events stay. Events are reduced per cell and type first."""
    u = units.where(F.col("level") == level)
    if parent is not None:
        u = u.where(F.col("parent_id") == parent)
    e = events if until is None else events.where(F.col("occurred_start") <= A.at(until))
    bands = ("High", "Medium", "Low", "Rumored")
    per_cell = e.groupBy("cell_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence_band") == b).alias(f"n_{b.lower()}") for b in bands])
    sums = ["n", *[f"n_{b.lower()}" for b in bands]]
    per_type = (context.select("cell_id", F.col(ADMIN_COLUMN[level]).alias("admin_id")).join(per_cell, "cell_id")
                .groupBy("admin_id", "event_type").agg(*[F.sum(c).alias(c) for c in sums]))
    per_unit = per_type.groupBy("admin_id").agg(*[F.sum(c).alias(c) for c in sums],
                                                F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("top_type"))
    d = u.select("admin_id", "name", "level", "parent_id").join(per_unit, "admin_id", "left")
    return d.select("admin_id", "name", "level", "parent_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], "top_type")


def breadcrumb(units: DataFrame, levels: int = 3) -> DataFrame:
    """(admin_id, ancestor_id, ancestor_name, ancestor_level) including the unit itself."""
    up = units.select(F.col("admin_id").alias("_id"), F.col("parent_id").alias("_next"))
    step = units.select("admin_id", F.col("admin_id").alias("ancestor_id"), F.col("parent_id").alias("_p"))
    out = step.select("admin_id", "ancestor_id")
    for _ in range(levels - 1):
        step = step.join(up, F.col("_p") == F.col("_id")).select("admin_id", F.col("_id").alias("ancestor_id"), F.col("_next").alias("_p"))
        out = out.unionByName(step.select("admin_id", "ancestor_id"))
    names = units.select(F.col("admin_id").alias("ancestor_id"), F.col("name").alias("ancestor_name"), F.col("level").alias("ancestor_level"))
    return out.join(names, "ancestor_id").select("admin_id", "ancestor_id", "ancestor_name", "ancestor_level")


def list_aois(aois: DataFrame, aoi_cells: DataFrame, events: DataFrame) -> DataFrame:
    """Areas with their distinct cells and events."""
    per_cell = events.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    c = aoi_cells.select("aoi_id", "cell_id").distinct().join(per_cell, "cell_id", "left")
    n = c.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"))
    return aois.select("aoi_id", "name").join(n, "aoi_id", "left").select(
        "aoi_id", "name", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def aoi_detail(aoi_cells: DataFrame, events: DataFrame) -> DataFrame:
    """Band counts of each area."""
    per_cell = events.groupBy("cell_id", "confidence_band").agg(F.count(F.lit(1)).alias("n"))
    return (aoi_cells.select("aoi_id", "cell_id").distinct().join(per_cell, "cell_id")
            .groupBy("aoi_id", "confidence_band").agg(F.sum("n").alias("n")))


def create_aoi(aoi_id: str, context: DataFrame, cells: DataFrame | None = None, admin_id: str | None = None,
               geometry: DataFrame | None = None) -> DataFrame:
    """Cells of a new area: listed cells, else an admin unit, else the cells that a geometry meets. None is an error.

    ``geometry`` holds polygons (``rings``) or lines (``vertices``); the area is all of them together. The
    context then needs the cells' boxes (sw_lon, sw_lat, step_lon, step_lat).
    """
    if cells is not None:
        c = cells.select("cell_id").join(context.select("cell_id"), "cell_id", "left_semi")
    elif admin_id is not None:
        hit = F.lit(False)
        for col in ADMIN_COLUMN.values():
            hit = hit | F.coalesce(F.col(col) == admin_id, F.lit(False))
        c = context.where(hit).select("cell_id")
    elif geometry is not None:
        shapes = geometry.select(F.monotonically_increasing_id().alias("shape"), *[x for x in ("rings", "vertices") if x in geometry.columns])
        c = cells_of_shapes(shapes, context, "shape").select("cell_id")
    else:
        raise ValueError("give cells, an admin unit or a geometry")
    c = c.distinct()
    if c.isEmpty():
        raise ValueError("the area holds no cells")
    return c.select(F.lit(aoi_id).alias("aoi_id"), "cell_id")


def geometry_aois(shapes: DataFrame, cells: DataFrame) -> DataFrame:
    """(aoi_id, cell_id) of many areas at once, each drawn as polygons or lines (`polygons.cells_of_shapes`)."""
    return cells_of_shapes(shapes, cells, "aoi_id")


def delete_aoi(aois: DataFrame, aoi_cells: DataFrame, aoi_id: str) -> tuple[DataFrame, DataFrame]:
    keep = F.col("aoi_id") != aoi_id
    return aois.where(keep), aoi_cells.where(keep)


def area_events(cells: DataFrame, events: DataFrame) -> DataFrame:
    return cells.join(events, "cell_id")


def area_anomalies(cells: DataFrame, anomalies: DataFrame) -> DataFrame:
    return cells.join(anomalies.select("cell_id", "subkind", "score"), "cell_id")


def area_attention(cells: DataFrame, events: DataFrame, anomalies: DataFrame | None, now: str, areas: DataFrame | None = None) -> DataFrame:
    """Attention of the areas that hold cells, or of all rows of ``areas``."""
    slim = events.select("cell_id", "occurred_start", "n_independent_families")
    found = None if anomalies is None else area_anomalies(cells, anomalies)
    return A.attention(cells if areas is None else areas, area_events(cells, slim), found, now)


def area_children(units: DataFrame, cells: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Next-level units of each unit with their attention, ranked; units without events stay.

    As in the drill-down of one area, anomalies play no part in the status of a child.
    """
    kids = units.where("parent_id is not null").select("parent_id", "admin_id", "name", F.concat(F.lit("admin:"), "admin_id").alias("area"))
    w = Window.partitionBy("parent_id").orderBy(*A.attention_order())
    return kids.join(area_attention(cells, events, None, now, kids), "area").withColumn("rank", F.row_number().over(w))


def significant_in_area(cells: DataFrame, scored: DataFrame, n: int = 50) -> DataFrame:
    w = Window.partitionBy("area").orderBy(F.desc("score"), "event_id")
    return cells.join(scored, "cell_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_in_area(cells: DataFrame, events: DataFrame, now: str, days: int = 30, n: int = 50) -> DataFrame:
    w = Window.partitionBy("area").orderBy(F.desc("occurred_end"), "event_id")
    e = events.where(F.col("occurred_start") >= A.at(now) - F.make_dt_interval(F.lit(days)))
    return cells.join(e, "cell_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sensor_name(family: Column) -> Column:
    from obsweave.dims import choose
    return choose(family, SENSOR_NAMES, family)


def area_facts(cells: DataFrame, events: DataFrame, anomalies: DataFrame, member_families: DataFrame, now: str, top_n: int = 5) -> DataFrame:
    """Facts per area. ``member_families`` is (cell_id, family); events may carry ``place_label``.

    Counts are made per cell before areas are joined, so a cell in several areas costs small rows.
    """
    for bad in ("lon", "lat", "geom"):
        if bad in events.columns:
            raise ValueError("precise coordinates must not enter area facts")
    t = F.col("occurred_start")
    recent_cut, prior_cut = (A.at(now) - F.make_dt_interval(F.lit(int(k * A.ATTENTION_DAYS))) for k in (1, 2))
    bands = ("High", "Medium", "Low", "Rumored")
    per = events.groupBy("cell_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t >= recent_cut).alias("recent"), F.count_if((t < recent_cut) & (t >= prior_cut)).alias("prior"),
        F.min(t).alias("first"), F.max(t).alias("last"), *[F.count_if(F.coalesce("confidence_band", F.lit("Rumored")) == b).alias(b) for b in bands])
    by_type = cells.join(per, "cell_id").groupBy("area", "event_type").agg(
        *[F.sum(c).alias(c) for c in ("n", "recent", "prior", *bands)], F.min("first").alias("first"), F.max("last").alias("last"))
    facts = by_type.groupBy("area").agg(
        F.sum("n").alias("n_events"), F.sum("recent").alias("recent"), F.sum("prior").alias("prior"), *[F.sum(b).alias(b) for b in bands],
        F.to_date(F.min("first")).alias("first_date"), F.to_date(F.max("last")).alias("last_date"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "event_type"))).alias("types"))
    anom = area_anomalies(cells, anomalies).groupBy("area").agg(F.array_sort(F.collect_set("subkind")).alias("anomalies"))
    fam = cells.join(member_families.distinct(), "cell_id").groupBy("area").agg(F.array_sort(F.collect_set(sensor_name(F.col("family")))).alias("sensors"))
    from obsweave.dims import choose
    rank = choose(F.col("confidence_band"), BAND_RANK, 3)
    w = Window.partitionBy("area").orderBy(rank, F.desc("occurred_start"), "event_id")
    place = F.col("place_label") if "place_label" in events.columns else F.lit(None).cast("string")
    top = (cells.join(events, "cell_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n).groupBy("area").agg(
        F.array_sort(F.collect_list(F.struct("r", "event_type", "confidence_band", place.alias("place"), F.to_date("occurred_start").alias("date")))).alias("top_events")))
    d = facts.join(anom, "area", "left").join(fam, "area", "left").join(top, "area", "left")
    empty = F.array().cast("array<string>")
    return (d.withColumn("anomalies", F.coalesce("anomalies", empty)).withColumn("sensors", F.coalesce("sensors", empty))
            .withColumn("by_type", F.array_join(F.transform("types", lambda x: F.concat(x["event_type"], F.lit("="), (-x["neg"]).cast("string"))), ","))
            .withColumn("top_type", F.col("types")[0]["event_type"]).drop("types"))


def area_labels(units: DataFrame, aois: DataFrame | None = None) -> DataFrame:
    """(area, kind, label, level, area_id) of every admin unit and user area."""
    d = units.select(F.concat(F.lit("admin:"), "admin_id").alias("area"), F.lit("admin").alias("kind"), F.col("name").alias("label"), F.col("level").cast("int").alias("level"))
    if aois is not None:
        d = d.unionByName(aois.select(F.concat(F.lit("aoi:"), F.col("aoi_id").cast("string")).alias("area"), F.lit("aoi").alias("kind"), F.col("name").alias("label"),
                                      F.lit(None).cast("int").alias("level")))
    return d


def area_context(labels: DataFrame, cells: DataFrame, events: DataFrame, anomalies: DataFrame, member_families: DataFrame, context: DataFrame, now: str,
                 places: DataFrame | None = None) -> DataFrame:
    """What is known of each area in one row: label, facts, attention and terrain.

    ``places`` (cell_id, label) names the surroundings of the top events. An area without cells, events or
    terrain keeps its row, with nulls and zeros.
    """
    named = events if places is None else events.join(places.select("cell_id", F.col("label").alias("place_label")), "cell_id", "left")
    facts = area_facts(cells, named, anomalies, member_families, now)
    att = area_attention(cells, events, anomalies, now, labels.select("area"))
    pack = lambda df, name: df.select("area", F.struct(*[c for c in df.columns if c != "area"]).alias(name))
    d = labels.join(pack(att, "attention"), "area", "left").join(pack(facts, "facts"), "area", "left")
    return d.join(pack(terrain_profile(cells, context), "terrain"), "area", "left")


def area_view(labels: DataFrame, cells: DataFrame, units: DataFrame, events: DataFrame, anomalies: DataFrame, member_families: DataFrame, context: DataFrame,
              significance: DataFrame, now: str, days: int = 30, n: int = 50, places: DataFrame | None = None) -> DataFrame:
    """The whole view of every area at once: label, read, attention, terrain, recent events, significant events and children.

    ``significance`` is the stored feed (event_id, cell_id, score, rationale). Lists are arrays of structs
    in order, of at most ``n`` entries: each is ranked within its area, and ranks beyond ``n`` are dropped
    in the tasks before areas meet. An area without something has an empty list.
    """
    ctx = area_context(labels, cells, events, anomalies, member_families, context, now, places)
    att = ctx.select("area", "attention.*")
    read = template_read(ctx.where("facts is not null").select("area", "facts.*"), att)
    listed = lambda df, name, *cols: df.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias(name))
    recent = listed(recent_in_area(cells, events, now, days, n), "recent", "event_id", "cell_id", "event_type", "confidence_band", "occurred_start")
    top = significance.join(events.select("event_id", "event_type", "confidence_band", "occurred_start"), "event_id")
    top = listed(significant_in_area(cells, top, n), "significant", "event_id", "score", "rationale", "event_type", "confidence_band", "cell_id", "occurred_start")
    kids = area_children(units, cells, events, now).select(F.concat(F.lit("admin:"), "parent_id").alias("area"), "rank", "admin_id", "name", "status", "n_events")
    kids = listed(kids, "children", "admin_id", "name", "status", "n_events")
    d = ctx.drop("facts").join(read.select("area", F.struct("summary", "indicators", "provenance", "generated_by", "input_hash").alias("read")), "area", "left")
    for part in (recent, top, kids):
        d = d.join(part, "area", "left")
    return d.withColumns({c: F.coalesce(c, F.array()) for c in ("recent", "significant", "children")})


def template_read(facts: DataFrame, attention: DataFrame) -> DataFrame:
    """Deterministic text per area."""
    d = facts.join(attention.select("area", "status"), "area")
    trend = F.when(F.col("status") == "escalating", "rising").when(F.col("status") == "quieting", "falling").otherwise("steady")
    has = lambda k: F.array_contains("anomalies", k)
    text = F.concat_ws(
        " ", F.concat("area", F.lit(": "), F.format_number("n_events", 0), F.lit(" recorded events, mostly "), A.spoken(F.col("top_type")), F.lit(".")),
        F.concat(F.lit("Activity is "), trend, F.lit(" ("), F.col("recent").cast("string"), F.lit(f" in the last {int(A.ATTENTION_DAYS)} days vs "),
                 F.col("prior").cast("string"), F.lit(" before).")),
        F.when(has("escalation"), "A new, more-severe event type has appeared here.").when(has("activity_spike"), "A recent flare-up is flagged."),
        F.when(F.col("High") > 0, F.concat(F.col("High").cast("string"), F.lit(" event(s) are multi-source confirmed."))))
    key = F.to_json(F.struct("anomalies", "High", "Medium", "Low", "Rumored", "n_events", "prior", "recent", "status", "by_type"))
    return d.select("area", text.alias("summary"), F.col("status").alias("indicators"), F.array_join("sensors", ",").alias("provenance"),
                    F.lit("template").alias("generated_by"), F.substring(F.sha1(key.cast("binary")), 1, 16).alias("input_hash"))


def upsert_reads(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached reads with changed or new areas replaced."""
    same = cached.select("area", "input_hash")
    changed = fresh.join(same, ["area", "input_hash"], "left_anti")
    return cached.join(changed.select("area"), "area", "left_anti").unionByName(changed.select(*cached.columns))


def synthesize_areas(facts: DataFrame, attention: DataFrame, cached: DataFrame | None = None, generate=None) -> DataFrame:
    """Reads of all areas; only areas whose facts changed are regenerated (``generated_by`` then is ``llm``).

    ``generate`` maps the changed areas' frame to (area, summary); areas it leaves out or leaves blank
    keep the template text.
    """
    base = template_read(facts, attention)
    fresh = base if cached is None else base.join(cached.select("area", "input_hash"), ["area", "input_hash"], "left_anti")
    if generate is not None:
        g = generate(fresh).select("area", F.nullif(F.trim("summary"), F.lit("")).alias("_g"))
        fresh = fresh.join(g, "area", "left").withColumn("generated_by", F.when(F.col("_g").isNotNull(), "llm").otherwise(F.col("generated_by"))).withColumn(
            "summary", F.coalesce("_g", "summary")).drop("_g")
    return fresh if cached is None else upsert_reads(cached, fresh)


def generate_by_model(model: Callable[[list[dict]], list]) -> Callable[[DataFrame], DataFrame]:
    """The hook of `synthesize_areas` for a model that gives one text per area row; an area whose call fails keeps its template."""
    def generate(changed: DataFrame) -> DataFrame:
        return ask_rows(changed, model, "area").select("area", F.col("answer").alias("summary"))
    return generate


def watch_list(attention: DataFrame, reads: DataFrame) -> DataFrame:
    """All areas with attention and read, ranked; an area without a read has a null summary."""
    return attention.join(reads.select("area", "summary", "generated_by"), "area", "left").orderBy(*A.attention_order())


def needs_attention(attention: DataFrame) -> DataFrame:
    """How many areas are watched and how many of them escalate."""
    return attention.agg(F.count(F.lit(1)).alias("n_areas"), F.count_if(F.col("status") == "escalating").alias("needs_attention"))
