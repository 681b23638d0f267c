"""From grouped records to events: adjudication, merge components, event assembly, audit and digest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions import text as T
from obsweave.functions.cells import is_valid_cell
from obsweave.operators import score
from obsweave.operators.block import block
from obsweave.functions.model_calls import ask_rows
from obsweave.operators.components import component_labels
from obsweave.session import cut

UNKNOWN_PRECISION_M = 1000.0     # fixed value
VERDICT_SCHEMA = "same boolean, confidence double, rationale string, evidence_spans array<string>, tier string"


# ------------------------------------------------------------------ adjudication
def landcover_by_obs(obs: DataFrame, context: DataFrame) -> DataFrame:
    """Dominant land-cover class of each record's cell."""
    return obs.join(context.select("cell_id", F.col("landcover_class").alias("landcover_code")), "cell_id", "left")


def colocated_edges(grouped: DataFrame) -> DataFrame:
    """Edges between persistent records of different families in one cell of a group.

    Every such pair is merged, and a cell with two or more families connects all its persistent
    records, so one edge per record to the cell's first record says the same.
    """
    lasting = grouped.where((F.col("window_us") >= dims.PERSISTENT_MIN_H * 3600 * 1_000_000) & F.col("group_id").isNotNull())
    hubs = (lasting.groupBy("group_id", "cell_id").agg(F.min("obs_id").alias("hub"),
            F.min("source_family_id").alias("f0"), F.max("source_family_id").alias("f1")).where("f0 <> f1"))
    return (lasting.join(hubs, ["group_id", "cell_id"]).where("obs_id <> hub")
            .select(F.col("hub").alias("a"), F.col("obs_id").alias("b")))


def colocated_pair_count(grouped: DataFrame) -> DataFrame:
    """How many pairs per cell the rule covers, from counts per family."""
    lasting = grouped.where((F.col("window_us") >= dims.PERSISTENT_MIN_H * 3600 * 1_000_000) & F.col("group_id").isNotNull())
    fam = lasting.groupBy("group_id", "cell_id", "source_family_id").agg(F.count(F.lit(1)).alias("n"))
    return (fam.groupBy("group_id", "cell_id").agg(F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("sq"))
            .select("group_id", "cell_id", F.expr("(n * n - sq) div 2").alias("pairs")).where("pairs > 0"))


def parse_verdicts(raw: DataFrame, payload: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """Verdict JSON -> (valid rows, rejected rows). Malformed text or a confidence outside [0, 1] is rejected."""
    d = raw.withColumn("v", F.from_json(payload, VERDICT_SCHEMA))
    same_json, conf_json = F.get_json_object(payload, "$.same"), F.get_json_object(payload, "$.confidence")
    ok = F.coalesce(F.col("v.same").isNotNull() & F.col("v.confidence").between(0, 1)
                    & same_json.isin("true", "false") & conf_json.isNotNull(), F.lit(False))
    keep = [c for c in raw.columns if c != payload]
    return d.where(ok).select(*keep, "v.*"), d.where(~ok).select(*raw.columns)


TIERS = ("gate", "adjudicator", "escalation")


def route_tiers(pairs: DataFrame, gate: DataFrame, adjudicator: DataFrame, escalation: DataFrame) -> DataFrame:
    """Verdict of the cheapest tier that is sure enough; salient types always go on.

    Each tier table has (pair_key, same, confidence).
    """
    salient = F.col("type_a").isin(dims.HIGH_SALIENCE) | F.col("type_b").isin(dims.HIGH_SALIENCE)
    d = pairs
    for name, t in (("g", gate), ("j", adjudicator), ("e", escalation)):
        d = d.join(t.select("pair_key", F.struct("same", "confidence").alias(name)), "pair_key", "left")
    pick = (F.when((F.col("g.confidence") >= dims.GATE_MIN) & ~salient, F.struct(F.lit("gate").alias("tier"), "g.*"))
            .when((F.col("j.confidence") >= dims.ADJUDICATOR_MIN) & ~salient, F.struct(F.lit("adjudicator").alias("tier"), "j.*"))
            .otherwise(F.struct(F.lit("escalation").alias("tier"), "e.*")))
    return d.withColumn("r", pick).select(*pairs.columns, "r.tier", "r.same", "r.confidence")


def gray_pairs(scored: DataFrame) -> DataFrame:
    """Undecided pairs with their pinned key."""
    g = scored.where((F.col("band") == "gray") & ~F.col("colocated"))
    return g.withColumn("pair_key", T.pair_key(F.col("hash_a"), F.col("hash_b"), F.col("type_a"), F.col("type_b")))


#: Words of the bit set of `may_hold`: 2 MB at most.
MOST_WORDS = 1 << 18


def may_hold(table: DataFrame, key: str) -> Column:
    """False for a row only if no row of ``table`` has its ``key``: one bit a key, in an array of words as large as their number asks."""
    spark = table.sparkSession
    words = 1 << min(MOST_WORDS.bit_length() - 1, (table.count() // 4 + 1024).bit_length())
    h = F.xxhash64(key)
    at, bit = F.pmod(h, F.lit(words)), F.shiftright(h, 40).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    found = table.groupBy(at.alias("id")).agg(F.bit_or(one).alias("w"))
    rows = spark.range(words).join(found, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    array = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("w"))
    return F.get(array.scalar(), at.cast("int")).bitwiseAND(one) != 0


def adjudicate(gray: DataFrame, verdicts: DataFrame | None,
               decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decision per gray pair. A miss keeps the pair apart and marks it; so does low confidence.

    Pairs whose key meets no bit of the cache are misses at once; only the others are dealt out to meet it. ``decide`` is the model hook: it gets the missed pairs and returns (pair_key, same, confidence)
    for those it could settle.
    """
    base = gray.select("obs_a", "obs_b", "pair_key", *[c for c in ("type_a", "type_b") if c in gray.columns])
    if verdicts is None:
        d = base.withColumn("same", F.lit(None).cast("boolean")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        cache = verdicts.select("pair_key", "same", "confidence")
        may = may_hold(cache, "pair_key")
        hit = base.where(may).join(cache, "pair_key", "left").select(*base.columns, "same", "confidence")
        miss = base.where(~may).select("*", *[F.lit(None).cast(cache.schema[c].dataType).alias(c) for c in ("same", "confidence")])
        d = hit.unionByName(miss)
    d = d.withColumn("source", F.when(F.col("same").isNotNull(), "cache"))
    if decide is not None:
        fresh = decide(d.where("source is null").drop("same", "confidence", "source"))
        d = (d.join(fresh.select("pair_key", F.col("same").alias("_s"), F.col("confidence").alias("_c")).dropDuplicates(["pair_key"]),
                    "pair_key", "left")
             .withColumn("source", F.coalesce("source", F.when(F.col("_s").isNotNull(), "verdict")))
             .withColumn("same", F.coalesce("same", "_s")).withColumn("confidence", F.coalesce("confidence", "_c")).drop("_s", "_c"))
    return (d.withColumn("source", F.coalesce("source", F.lit("degraded_keep_separate")))
            .withColumn("same", F.coalesce("same", F.lit(False)))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
            .withColumn("needs_check", (F.col("source") == "degraded_keep_separate") | (F.col("confidence") < 0.5)))


def decide_by_model(model: Callable[[list[dict]], list], batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """The hook of `adjudicate` for a model that gives one verdict as JSON per pair.

    Answers go through `parse_verdicts`; a pair whose call fails, or whose answer is malformed, has no
    verdict and so stays apart and marked, while the others of its batch keep theirs.
    """
    def decide(missed: DataFrame) -> DataFrame:
        good, _bad = parse_verdicts(ask_rows(missed, model, "pair_key", batch), "answer")
        return good.select("pair_key", "same", "confidence")
    return decide


def flagged_obs(decisions: DataFrame) -> DataFrame:
    return (decisions.where("needs_check").select(F.explode(F.array("obs_a", "obs_b")).alias("obs_id")).distinct())


def new_verdicts(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fresh verdicts to append to the cache: unknown keys only, one row per key."""
    fresh = decisions.where("source = 'verdict'").dropDuplicates(["pair_key"])
    return fresh.select("pair_key", "same", "confidence").join(verdicts.select("pair_key"), "pair_key", "left_anti")


# ------------------------------------------------------------------ events
def confidence_band(confidence: Column, families: Column) -> Column:
    return (F.when(families < 2, "Rumored")
            .when((confidence >= dims.BAND_HIGH_MIN) & (families >= dims.BAND_HIGH_FAMILIES), "High")
            .when(confidence >= dims.BAND_MEDIUM_MIN, "Medium")
            .when(confidence >= dims.BAND_LOW_MIN, "Low").otherwise("Rumored"))


def noisy_or(members: DataFrame, key: str = "component") -> DataFrame:
    """1 - prod(1 - best reliability per family), and the number of families."""
    fam = members.groupBy(key, dims.family(F.col("source_id")).alias("family")).agg(
        F.max(dims.reliability(F.col("source_id"))).alias("c"))
    # families per event are bounded by the source table or by distinct unknown sources; ln avoids an array
    return fam.groupBy(key).agg(F.round(1 - F.exp(F.sum(F.ln(1 - F.col("c")))), 12).alias("confidence"),
                                F.count(F.lit(1)).alias("n_independent_families"))


def type_mode(members: DataFrame, key: str = "component") -> DataFrame:
    n = members.groupBy(key, "obs_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by("obs_type", F.struct(-F.col("n"), F.col("obs_type"))).alias("event_type"))


def event_flags(n_families: Column, n_sources: Column, needs_check: Column, band: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(
        F.when((n_families == 1) & (n_sources > 1), "echo-only"),
        F.when(needs_check, "verification-needed"),
        F.when(band == "Rumored", F.when(n_families == 1, "single-source").otherwise("low-confidence")))))


def fingerprint(value: Column) -> tuple[Column, Column]:
    """Order-free identity of a set of values: sums over two 60-bit parts of their hashes."""
    h = F.sha2(value, 256)
    one, two = (F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17))
    return one, two


def build_events(members: DataFrame, theater: str = "ua_donbas") -> DataFrame:
    """One event per ``component`` of rows (obs_id, component, source_id, obs_type, cell_id, ...).

    The id comes from type, cell and ``member_digest`` (number and fingerprint of the members), which
    is combined in the map tasks, so events of any size are treated alike; their members are rows of
    the bridge (`event_members`). ``theater`` stands in for members without a theater of their own.
    """
    own = F.coalesce(F.min("theater_id"), F.lit(theater)) if "theater_id" in members.columns else F.lit(theater)
    one, two = fingerprint(F.col("obs_id"))
    rep = F.struct(F.col("geom_precision_m").alias("p"), F.col("cell_id").alias("c"))
    core = members.groupBy("component").agg(
        F.min("occurred_start").alias("occurred_start"), F.max("occurred_end").alias("occurred_end"),
        F.count(F.lit(1)).alias("n_sources"), F.min(rep).alias("rep"),
        F.max(F.coalesce(F.col("needs_check"), F.lit(False))).alias("needs_check"), own.alias("theater_id"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), one, two).alias("member_digest"))
    d = core.join(noisy_or(members), "component").join(type_mode(members), "component")
    d = (d.withColumn("cell_id", F.col("rep.c")).withColumn("resolved_precision_m", F.col("rep.p"))
         .withColumn("confidence_band", confidence_band(F.col("confidence"), F.col("n_independent_families")))
         .withColumn("status", F.when(F.col("n_independent_families") >= 2, "confirmed").otherwise("candidate")))
    d = d.withColumn("flags", event_flags(F.col("n_independent_families"), F.col("n_sources"), F.col("needs_check"), F.col("confidence_band")))
    return d.select(
        T.uuid_form(F.sha2(F.concat_ws("|", "event_type", "cell_id", "member_digest"), 256)).alias("event_id"),
        "theater_id", "component", "event_type", "cell_id", "occurred_start", "occurred_end", "status",
        F.round("confidence", 6).alias("confidence"), "confidence_band", "n_sources", "n_independent_families", "resolved_precision_m", "flags", "member_digest")


def published_events(members: DataFrame, events: DataFrame) -> DataFrame:
    """Events in the published form, for gate-sized tables: the sorted member list is in the row and in the id."""
    lists = members.groupBy("component").agg(F.array_sort(F.collect_list("obs_id")).alias("created_from_obs"))
    ident = F.concat_ws("|", "event_type", "cell_id", F.array_join("created_from_obs", "|"))
    return events.join(lists, "component").withColumn("event_id", T.uuid_form(F.sha2(ident, 256)))


def propagate(obs: DataFrame, edges: DataFrame, flagged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with ``component``, rejections). Records without a cell are rejected as ``no_cell``
    and their edges ignored; every other record is in exactly one component."""
    placed = obs.where("cell_id is not null and cell_id <> ''")
    rejected = obs.where("cell_id is null or cell_id = ''").select("obs_id", F.lit("no_cell").alias("reason"))
    # the few ends that are no placed record are sought, so that the edges themselves need not be dealt out
    ends = edges.select(F.explode(F.array("a", "b")).alias("obs_id")).distinct()
    strays = cut(ends.join(placed.select("obs_id"), "obs_id", "left_anti"))
    e = edges
    if not strays.isEmpty():
        e = (edges.join(strays.withColumnRenamed("obs_id", "a"), "a", "left_anti")
             .join(strays.withColumnRenamed("obs_id", "b"), "b", "left_anti"))
    labels = component_labels(e).withColumnRenamed("id", "obs_id")
    m = placed.join(labels, "obs_id", "left").withColumn("component", F.coalesce("label", "obs_id")).drop("label")
    if flagged is not None:
        m = m.join(flagged.withColumn("needs_check", F.lit(True)), "obs_id", "left")
    else:
        m = m.withColumn("needs_check", F.lit(False))
    return m, rejected


def event_members(members: DataFrame, events: DataFrame) -> DataFrame:
    """Bridge rows event -> record."""
    return members.select("component", "obs_id").join(events.select("component", "event_id"), "component").select("event_id", "obs_id")


@dataclass
class Fusion:
    """Frames of one fusion run; all are lazy except the checkpointed groups, pairs and members."""

    grouped: DataFrame
    scored: DataFrame
    decisions: DataFrame
    members: DataFrame
    events: DataFrame
    rejections: DataFrame


def with_precision(obs: DataFrame) -> DataFrame:
    """Records of unknown precision (null, zero or less) count as precise to 1 km, the size of a cell."""
    p = F.col("geom_precision_m")
    return obs.withColumn("geom_precision_m", F.when(p > 0, p).otherwise(F.lit(UNKNOWN_PRECISION_M)))


def group(obs: DataFrame, landcover: str | None = None) -> DataFrame:
    """Records with group and pair features, materialised for the two sides of the pair join."""
    return cut(score.prepare(block(with_precision(obs)), landcover))


def fuse(obs: DataFrame, verdicts: DataFrame | None = None, theater: str = "ua_donbas", landcover: str | None = None,
         decide: Callable[[DataFrame], DataFrame] | None = None, small_rows: int = score.SMALL_GROUP_ROWS) -> Fusion:
    grouped = group(obs, landcover)
    scored = cut(score.scored_pairs(grouped, small_rows)
                 .where("band <> 'different'")
                 .select("obs_a", "obs_b", "hash_a", "hash_b", "type_a", "type_b", "p", "band", "colocated",
                         "s_geo", "s_time", "s_text", "s_type", "landcover_mult"))
    decisions = adjudicate(gray_pairs(scored), verdicts, decide)
    if decide is not None:
        decisions = cut(decisions)
    edges = (scored.where("band = 'same'").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))
             .unionByName(colocated_edges(grouped))
             .unionByName(decisions.where("same").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))))
    own = ["theater_id"] if "theater_id" in grouped.columns else []
    slim = grouped.select("obs_id", *own, "source_id", "obs_type", "cell_id", "occurred_start", "occurred_end", "geom_precision_m")
    members, rejections = propagate(slim, edges, flagged_obs(decisions))
    members = cut(members)
    return Fusion(grouped, scored, decisions, members, build_events(members, theater), rejections)


# ------------------------------------------------------------------ audits
def coverage_audit(obs: DataFrame, members: DataFrame, rejections: DataFrame) -> DataFrame:
    """Counts that prove no record was dropped or doubled."""
    got = members.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n_events"))
    rej = rejections.select("obs_id").distinct().withColumn("rejected", F.lit(1))
    j = (obs.select("obs_id").withColumn("known", F.lit(1)).join(got, "obs_id", "full").join(rej, "obs_id", "full"))
    out = j.agg(F.count("known").alias("input"), F.count("n_events").alias("in_events"), F.count("rejected").alias("rejected"),
                F.coalesce(F.sum(F.col("n_events") - 1), F.lit(0)).alias("duplicated"),
                F.count_if(F.col("known").isNotNull() & F.col("n_events").isNull() & F.col("rejected").isNull()).alias("unaccounted"),
                F.count_if(F.col("known").isNull()).alias("extra"))
    return out.withColumn("ok", F.expr("duplicated = 0 and unaccounted = 0 and extra = 0"))


def canonical_line(obs: Column) -> Column:
    """Sorted-key JSON text of an event, as the digest reads it; ``obs`` is the JSON of its members."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [('"band": ', q(F.col("confidence_band"))), (', "cell_id": ', q(F.col("cell_id"))),
             (', "confidence": ', F.col("confidence").cast("string")), (', "event_type": ', q(F.col("event_type"))),
             (', "flags": ', json_list("flags")), (', "n_families": ', F.col("n_independent_families").cast("string")),
             (', "obs": ', obs), (', "status": ', q(F.col("status")))]
    cols = [F.lit("{")]
    for k, v in parts:
        cols += [F.lit(k), v]
    return F.concat(*cols, F.lit("}"))


def json_list(column: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(column, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", "), F.lit("]"))


def digest(events: DataFrame) -> DataFrame:
    """Order-free identity of an event table: row count and sums over per-line hashes.

    It is a plain aggregation, so it works at any size; `digest_sha256` gives the published form.
    """
    lines = events.select(canonical_line(F.concat(F.lit('"'), "member_digest", F.lit('"'))).alias("line"))
    one, two = fingerprint(F.col("line"))
    return lines.agg(F.count(F.lit(1)).alias("n_events"), one.alias("sum_a"), two.alias("sum_b"))


def digest_sha256(events: DataFrame) -> str:
    """sha256 over the sorted canonical lines of `published_events`. It streams lines partition by partition, so use it for
    gate-sized event tables; `digest` compares runs of any size."""
    import hashlib

    h, first = hashlib.sha256(), True
    for row in events.select(canonical_line(json_list("created_from_obs")).alias("line")).orderBy("line").toLocalIterator():
        h.update(row["line"].encode() if first else b"\n" + row["line"].encode())
        first = False
    return h.hexdigest()


def run_counters(grouped: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: pairs seen, cache hits, model calls, pairs kept apart; with a ``tier`` also the verdicts of each tier."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in TIERS] if "tier" in decisions.columns else []
    d = decisions.agg(*tiers, F.count_if(F.col("source") == "cache").alias("cache_hits"),
                      F.count_if(F.col("source") == "verdict").alias("model_calls"),
                      F.count_if(F.col("source") == "degraded_keep_separate").alias("degraded_keep_separate"))
    one = score.pair_totals(grouped).withColumn("_k", F.lit(1)).join(d.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("cache_hit_rate", F.round(F.when(F.col("pairs_seen") > 0, F.col("cache_hits") / F.col("pairs_seen")).otherwise(0.0), 4))


def fusion_summary(events: DataFrame, rejections: DataFrame | None = None) -> DataFrame:
    """(confidence_band, n_events, n_obs) per band; with a ledger also a line ``all`` and the records ``dropped``."""
    d = events.groupBy("confidence_band").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n_sources").alias("n_obs"))
    if rejections is None:
        return d
    out = d.unionByName(d.agg(F.lit("all").alias("confidence_band"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs")))
    return out.unionByName(rejections.agg(F.lit("dropped").alias("confidence_band"), F.lit(0).cast("long").alias("n_events"), F.count(F.lit(1)).alias("n_obs")))


def replay_check(first: DataFrame, second: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Digest equality of two runs and the stored event count."""
    a = digest(first).withColumn("_k", F.lit(1))
    b = digest(second).select(F.lit(1).alias("_k"), F.struct("n_events", "sum_a", "sum_b").alias("again"))
    d = a.join(b, "_k").select(
        (F.struct("n_events", "sum_a", "sum_b") == F.col("again")).alias("digest_equal"), F.col("n_events").alias("replayed_events"))
    if stored is not None:
        n = stored.agg(F.count(F.lit(1)).alias("stored_events")).withColumn("_k", F.lit(1))
        d = d.withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")
    return d


def freeze_verdicts(labels: DataFrame, fallback: dict[str, str] | None = None) -> DataFrame:
    """Newest labelled verdict per pair key; missing pinned versions use the fallback, else the run fails."""
    fb = fallback or {}
    d = labels
    for v in ("prompt_version", "model_version", "schema_version", "embedding_version"):
        col = F.coalesce(F.col(v), F.lit(fb[v])) if v in fb else F.coalesce(F.col(v), F.raise_error(F.lit(f"label without {v}")).cast("string"))
        d = d.withColumn(v, col)
    key = T.pair_key(*[F.col(c) for c in ("hash_a", "hash_b", "type_a", "type_b", "prompt_version", "model_version", "schema_version", "embedding_version")])
    return d.withColumn("pair_key", key).groupBy("pair_key").agg(
        F.max_by(F.struct("same", "confidence"), F.struct("created_at", "label_id")).alias("v")).select("pair_key", "v.*")
