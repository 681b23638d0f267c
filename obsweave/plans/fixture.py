"""The deterministic map from the driver tables to raw observations.

Every row of ``events`` becomes one raw report; its text is built from the whole values of the event
and of the document it points to. `plans/oracle.py` states the same map in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions.cells import with_cell
from obsweave.operators import ingest as I
from obsweave.session import cut

THEATER = "ua_donbas"
BBOX = (36.0, 46.8, 39.5, 49.5)
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frac(c):
    return c - F.floor(c)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("doc_source"))
    d = (ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
         .withColumn("site", F.floor(F.col("user_id") / 3).cast("long"))
         .withColumn("doc_id", F.col("event_id") % docs.agg(F.count(F.lit(1))).scalar()).join(docs, "doc_id", "left"))
    t, k = F.col("event_type"), F.col("k")
    burn, bld_s, bld_e = (t == "purchase") & (k % 5 == 1), (t == "signup") & (k % 4 == 0), (t == "error") & (k % 5 == 2)
    kind = (F.when(k == 27, "unknown").when(t == "view", "strike").when(t == "click", "artillery_fire").when(burn, "burn_scar")
            .when(t == "purchase", "fire").when(bld_s | bld_e, "building_damaged").when(t == "signup", "strike").otherwise("explosion"))
    source = (F.when(t == "view", "ucdp_ged_bulk").when(t == "click", "gdelt_v2").when(burn, "sentinel2_optical_index")
              .when(t == "purchase", "firms_viirs_snpp").when(t == "signup", "sentinel1_sar_logratio")
              .when(bld_e, "unosat").otherwise("acled_api"))
    modality = (F.when(k == 13, "sonar").when(t.isin("view", "click"), "text").when(burn, "imagery").when(t == "purchase", "thermal")
                .when((t == "signup") | bld_e, "imagery").otherwise("text"))
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    tail = F.when(k % 3 == 0, F.concat(F.lit("witness "), "lang", F.lit(" "), "doc_source")).otherwise(F.lit("heavy damage near market"))
    d = (d.withColumn("source_id", source).withColumn("modality", modality).withColumn("obs_type", kind)
         .withColumn("lon", F.round(36.0 + 3.5 * frac(F.col("site") * 0.61803398875) + 0.012 * (F.col("user_id") % 3), 6))
         .withColumn("lat", F.round(46.8 + 2.7 * frac(F.col("site") * 0.75487766625), 6))
         .withColumn("geom_precision_m", (300 + 10 * k).cast("double"))
         .withColumn("place_id", F.when(k % 10 == 0, F.col("site")))
         .withColumn("occurred_start", slot).withColumn("occurred_end", slot + F.expr("interval 1 hour"))
         .withColumn("text", F.concat(t, F.lit(" incident reported at site "), F.col("user_id").cast("string"), F.lit(" "), tail)))
    return d.select("event_id", "user_id", "k", "source_id", "modality", "obs_type", "lon", "lat", "geom_precision_m", "place_id",
                    "occurred_start", "occurred_end", "text", F.lit(THEATER).alias("theater_id"))


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the sites that lie in the theater box: the grid that points must fall into."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("site", F.floor(F.col("user_id") / 3))
    pts = users.select(F.round(36.0 + 3.5 * frac(F.col("site") * 0.61803398875) + 0.012 * (F.col("user_id") % 3), 6).alias("lon"),
                       F.round(46.8 + 2.7 * frac(F.col("site") * 0.75487766625), 6).alias("lat"))
    w, s, e, n = BBOX
    return with_cell(pts.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)), "lon", "lat").select("cell_id").distinct()


def normalized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return I.normalize(raw_observations(spark, sf_dir), grid=grid_of(spark, sf_dir), order="event_id")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir)[0]


_stored: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table that the read queries share, written once per application and read from its files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = cut(build())
    return _stored[key]


def stored_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as a table, as fusion finds them in the log."""
    return stored(spark, sf_dir, "observations", lambda: observations(spark, sf_dir))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "events", lambda: event_table(spark, sf_dir))


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stored_observations(spark, sf_dir).withColumn("needs_check", F.col("k") % 7 == 0)
    return o.withColumn("component", F.concat_ws("|", "cell_id", "obs_type", F.date_format("occurred_start", "yyyy-MM-dd")))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by plain rule (one per cell, type and UTC date), for the operators that read events.

    The fusion queries build theirs from scored pairs; this table keeps downstream checks in SQL cheap
    without leaving out any record.
    """
    from obsweave.operators import fuse as FU

    return FU.build_events(event_members(spark, sf_dir), THEATER)
