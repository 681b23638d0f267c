"""Normalisation: validate, place on the grid, hash, remove exact repeats; nothing is dropped silently."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions import text as T
from obsweave.functions.cells import is_valid_cell, with_cell
from obsweave.session import cut

PRECISE_MAX_M = 500.0
FUZZY_MIN = 0.4


# ------------------------------------------------------------------ validation
def enum_reason(modality: Column, obs_type: Column) -> Column:
    """Reject reason of a record, modality first; null when both are known."""
    return (F.when(~F.coalesce(modality.isin(dims.MODALITIES), F.lit(False)), "invalid_modality")
            .when(~F.coalesce(obs_type.isin(dims.EVENT_TYPES), F.lit(False)), "invalid_type"))


def validate_enums(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", enum_reason(F.col("modality"), F.col("obs_type")))


def assert_source_permitted(df: DataFrame, forbidden: list[str], column: str = "source") -> DataFrame:
    """The frame unchanged; its evaluation fails on the first forbidden source."""
    bad = F.lit(False)
    for word in forbidden:
        bad = bad | F.contains(F.lower(F.col(column)), F.lit(word.lower()))
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("forbidden source: "), F.col(column))).cast("string"))
                         .otherwise(F.col(column)))


def nonempty_end(start: Column, end: Column) -> Column:
    return F.when(end.isNull() | (end <= start), start + F.expr("interval 1 second")).otherwise(end)


# ------------------------------------------------------------------ place resolution
def with_point_cell(df: DataFrame, grid: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cell of the point if the grid has it, and whether the point is precise enough to show."""
    known = grid.select(F.col("cell_id").alias("point_cell")).distinct().withColumn("_known", F.lit(True))
    d = with_cell(df, lon, lat, "point_cell").join(known, "point_cell", "left")
    return (d.withColumn("point_cell", F.when(F.col("_known"), F.col("point_cell")))
            .withColumn("resolution", F.when(F.col("point_cell").isNotNull(), F.when(
                F.col("geom_precision_m") <= PRECISE_MAX_M, "PRECISE").otherwise("COARSE")))).drop("_known")


def _theater(names: DataFrame, alias: DataFrame) -> list[str]:
    """Names are looked up within their theater where both sides tell one."""
    return ["theater_id"] if "theater_id" in names.columns and "theater_id" in alias.columns else []


def snapped(alias: DataFrame, grid: DataFrame) -> DataFrame:
    """Aliases without a cell get that of their point, if they have one and the grid knows its cell."""
    if "lon" not in alias.columns or "lat" not in alias.columns:
        return alias
    # only these rows meet the grid, so no null key gathers the others
    need = F.col("cell_id").isNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    known = grid.select("cell_id").distinct().withColumn("_known", F.lit(True))
    d = with_cell(alias.where(need).drop("cell_id"), "lon", "lat").join(known, "cell_id", "left")
    d = d.withColumn("cell_id", F.when(F.col("_known"), F.col("cell_id"))).select(*alias.columns)
    return alias.where(~need).unionByName(d)


def best_alias(alias: DataFrame, theater: list[str] | None = None) -> DataFrame:
    """One alias per case-folded name: preferred first, then the lowest alias id; it may have no cell."""
    other = ~F.coalesce("is_preferred", F.lit(False))
    return (alias.groupBy(*(theater or []), F.lower(F.trim("name")).alias("name_key"))
            .agg(F.min_by(F.struct("place_id", "cell_id"), F.struct(other, "alias_id")).alias("p")))


def resolve_place_exact(names: DataFrame, alias: DataFrame, name: str = "place_name") -> DataFrame:
    """Distinct names of a theater with the place and cell of an equal alias; the cell is null where the alias has none."""
    on = _theater(names, alias)
    d = names.select(*on, name).distinct().withColumn("name_key", F.lower(F.trim(name)))
    return d.join(best_alias(alias, on), [*on, "name_key"]).select(*on, name, F.col("p.place_id").alias("place_id"), F.col("p.cell_id").alias("cell_id"))


def resolve_place_fuzzy(names: DataFrame, alias: DataFrame, name: str = "place_name", threshold: float = FUZZY_MIN) -> DataFrame:
    """Distinct names of a theater with their most similar alias by trigram sets, above the threshold; equal ones: the lowest alias id.

    A trigram inverted index drives the join. A pair above the threshold t shares more than t of the
    larger set, so it must share one of the first ``n - ceil(t*n) + 1`` grams in a common order; only
    those are indexed, rare grams first, which keeps frequent grams out of the join. Sets are compared
    once for all aliases of equal spelling.
    """
    on = _theater(names, alias)
    known = alias.where("name is not null").groupBy(*on, F.col("name").alias("_spelt")).agg(F.min_by(F.struct("place_id", "cell_id", "alias_id"), "alias_id").alias("p"))

    def grams(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("grams", T.pg_trigrams(F.col(key))).where(F.size("grams") > 0)

    q = grams(names.where(F.col(name).isNotNull()).select(*on, name).distinct(), name)
    a = grams(known, "_spelt")
    freq = a.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        g = df.select(*on, key, F.size("grams").alias("n"), F.explode("grams").alias("g")).join(freq, "g", "left")
        s = g.groupBy(*on, key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("o"))
        keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
        return s.select(*on, key, F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select(*on, key, F.col("x.g").alias("g"))

    cand = prefix(q, name).join(prefix(a, "_spelt"), [*on, "g"]).select(*on, name, "_spelt").distinct()
    d = cand.join(q.withColumnRenamed("grams", "qg"), [*on, name]).join(a.withColumnRenamed("grams", "ag"), [*on, "_spelt"])
    inter = F.size(F.array_intersect("qg", "ag"))
    d = d.withColumn("similarity", inter / (F.size("qg") + F.size("ag") - inter)).where(F.col("similarity") > threshold)
    best = d.groupBy(*on, name).agg(F.max_by(F.struct("p", "similarity"), F.struct("similarity", -F.col("p.alias_id"))).alias("b"))
    return best.select(*on, name, F.col("b.p.place_id").alias("place_id"), F.col("b.p.cell_id").alias("cell_id"), F.round("b.similarity", 6).alias("similarity"))


def resolve_to_cell(df: DataFrame, grid: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Add ``cell_id`` from the point, else an equal place name, else a similar one; and how it was found.

    Names are looked up in the record's theater if the aliases have one. An alias without a cell is placed by its
    own point; one that cannot be placed leaves the record without a cell, no second alias is tried.
    Place-only records carry the flag ``place_name_only`` and the place id.
    """
    d = with_point_cell(df, grid)
    if alias is None or "place_name" not in df.columns:
        return (d.withColumn("cell_id", F.col("point_cell")).withColumn("resolved_by", F.when(F.col("cell_id").isNotNull(), "point"))
                .withColumn("place_name_only", F.lit(False)).drop("point_cell"))
    alias, on = snapped(alias, grid), _theater(df, alias)
    need = d.where("point_cell is null and place_name <> ''").select(*on, "place_name").distinct()
    exact = resolve_place_exact(need, alias)
    rest = need.join(exact.select(*on, "place_name"), [*on, "place_name"], "left_anti")
    fuzzy = resolve_place_fuzzy(rest, alias)
    hit = (exact.withColumn("how", F.lit("exact")).withColumn("similarity", F.lit(1.0))
           .unionByName(fuzzy.withColumn("how", F.lit("fuzzy")))
           .select(*on, "place_name", F.col("place_id").alias("alias_place"), F.col("cell_id").alias("alias_cell"), "how"))
    d = d.join(hit, [*on, "place_name"], "left")
    by_name = F.col("point_cell").isNull() & F.col("alias_cell").isNotNull()
    own = F.col("place_id") if "place_id" in df.columns else F.lit(None)
    return (d.withColumn("cell_id", F.coalesce("point_cell", F.when(by_name, F.col("alias_cell"))))
            .withColumn("resolved_by", F.when(F.col("point_cell").isNotNull(), "point").when(by_name, F.col("how")))
            .withColumn("place_name_only", by_name).withColumn("place_id", F.when(by_name, F.col("alias_place")).otherwise(own))
            .withColumn("resolution", F.when(by_name, "place_only").otherwise(F.col("resolution")))
            .drop("point_cell", "alias_cell", "alias_place", "how"))


# ------------------------------------------------------------------ identity and repeats
def with_identity(df: DataFrame) -> DataFrame:
    d = (df.withColumn("occurred_end", nonempty_end(F.col("occurred_start"), F.col("occurred_end")))
         .withColumn("text", T.normalize_text(F.col("text")))
         .withColumn("source_family_id", dims.family(F.col("source_id"))))
    return (d.withColumn("content_hash", T.content_hash(F.col("text"), F.col("cell_id"), F.col("occurred_start"), clean=True))
            .withColumn("obs_id", T.det_uuid(F.col("content_hash"))))


def mark_repeats(df: DataFrame, order: str) -> DataFrame:
    """``is_first``: the row is the first of its content hash in input order.

    The first order value per hash is a plain minimum, so a hash shared by very many rows is reduced
    in the map tasks instead of being sorted in one window partition.
    """
    first = df.groupBy("content_hash").agg(F.min(order).alias("_first"))
    return df.join(first, "content_hash").withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")


def mark_new(df: DataFrame, log: DataFrame, order: str) -> DataFrame:
    """``is_new``: the row is the first of its content hash in input order, and an append-only log does not have it."""
    d = mark_repeats(df, order).join(log.select("content_hash").distinct().withColumn("_logged", F.lit(True)), "content_hash", "left")
    return d.withColumn("is_new", F.col("is_first") & F.col("_logged").isNull()).drop("is_first", "_logged")


def split_new(df: DataFrame, log: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, exact repeats) against an append-only log and within the batch."""
    d = mark_new(df, log, order)
    return d.where("is_new").drop("is_new"), d.where("not is_new").drop("is_new")


def payload(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*[c for c in columns if c in df.columns]))


def normalize(raw: DataFrame, grid: DataFrame, order: str, alias: DataFrame | None = None,
              log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw reports -> (observations, rejections); the two are disjoint and together cover the input.

    Reasons, first match wins: invalid_modality, invalid_type, no_cell_resolve, exact_dup.
    """
    v = validate_enums(raw)
    bad = v.where("reason is not null")
    d = resolve_to_cell(v.where("reason is null").drop("reason"), grid, alias)
    # both outputs and the search for first copies read the named records, so they are written once; those
    # without a cell also keep the fields that naming changes
    came = {c: F.col(c) for c in ("text", "occurred_end")}
    d = cut(with_identity(d.withColumns({f"_{c}": F.when(F.col("cell_id").isNull(), v) for c, v in came.items()})))
    kept = [f"_{c}" for c in came]
    lost = d.where("cell_id is null").withColumns({c: F.col(f"_{c}") for c in came}).withColumn("reason", F.lit("no_cell_resolve"))
    named = d.where("cell_id is not null").drop(*kept)
    if log is None:
        m = mark_repeats(named, order)
        obs, dup = m.where("is_first").drop("is_first"), m.where("not is_first").drop("is_first")
    else:
        obs, dup = split_new(named, log, order)
    dup = dup.withColumn("reason", F.lit("exact_dup"))
    cols = raw.columns
    rejected = bad.select(*cols, "reason").unionByName(lost.select(*cols, "reason")).unionByName(dup.select(*cols, "reason"))
    rejections = rejected.select(order, "theater_id", "source_id", payload(raw, cols).alias("raw_payload"), "reason")
    return obs.drop("lon", "lat"), rejections


def observations_from_cells(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Records that already carry a cell: validate, hash and deduplicate without resolving again."""
    reason = F.coalesce(enum_reason(F.col("modality"), F.col("obs_type")),
                        F.when(~is_valid_cell(F.col("cell_id")), "invalid_geom"))
    v = df.withColumn("reason", reason)
    m = mark_repeats(with_identity(v.where("reason is null").drop("reason")), order)
    rej = v.where("reason is not null").select(order, "reason").unionByName(
        m.where("not is_first").select(order, F.lit("exact_dup").alias("reason")))
    return m.where("is_first").drop("is_first"), rej


def ingest_counters(seen: DataFrame, obs: DataFrame, rejections: DataFrame) -> DataFrame:
    """(counter, n): seen, ingested, rejected and one line per reason."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    by = rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return (one(seen, "seen").unionByName(one(obs, "ingested")).unionByName(
        by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("rejected").alias("counter"), "n"))
        .unionByName(by.select(F.concat(F.lit("reason:"), "reason").alias("counter"), "n")))


# ------------------------------------------------------------------ embeddings
def embed_text(df: DataFrame, model, dim: int, text: str = "text") -> DataFrame:
    """Vectors from a pluggable model, in Arrow batches; blank text gives null, a wrong size fails.

    ``model`` maps a list of texts to a list of vectors and is loaded once per task.
    """
    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), dtype=object)
        use = [i for i, t in enumerate(col) if isinstance(t, str) and t.strip()]
        for i, v in zip(use, model([col.iloc[i] for i in use]) if use else []):
            out.iloc[i] = [float(x) for x in v]
        return out

    d = df.withColumn("embedding", run(F.col(text)))
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    return d.withColumn("embedding", F.when(wrong, F.raise_error(F.lit(f"embedding size is not {dim}")).cast("array<double>"))
                        .otherwise(F.col("embedding")))


# ------------------------------------------------------------------ pre-aggregation of feeds
def period_key(ts: Column, granularity: str) -> Column:
    """Period label: date, ISO year-week or year-month."""
    if granularity == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if granularity == "month":
        return F.date_format(ts, "yyyy-MM")
    thursday = F.date_add(F.to_date(ts), 4 - (F.weekday(ts) + 1))
    return F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(ts))
