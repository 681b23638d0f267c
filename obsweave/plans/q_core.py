"""Queries for the leaf expressions, normalisation and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions import cells, text as T, timegeo as G
from obsweave.operators import block as B
from obsweave.operators import fuse as FU
from obsweave.operators import ingest as I
from obsweave.operators import score as S
from obsweave.plans import fixture as X
from obsweave.plans.oracle import D, RADIUS_M, WINDOW_H, case, with_

Q: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ normalisation
@query("normalize_observations", with_("norm", """SELECT event_id, obs_id, content_hash, cell_id, source_family_id, obs_type, modality,
 CASE WHEN geom_precision_m <= 500 THEN 'PRECISE' ELSE 'COARSE' END AS resolution, occurred_start, occurred_end FROM obs"""))
def _(spark, sf):
    return X.observations(spark, sf).select("event_id", "obs_id", "content_hash", "cell_id", "source_family_id", "obs_type", "modality",
                                            "resolution", "occurred_start", "occurred_end")


@query("normalize_rejections", with_("norm", "SELECT event_id, theater_id, source_id, reason FROM (SELECT *, 'ua_donbas' AS theater_id FROM ranked) WHERE reason IS NOT NULL"))
def _(spark, sf):
    return X.normalized(spark, sf)[1].drop("raw_payload")


@query("ingest_counters", with_("norm", """SELECT 'seen' AS counter, count(*) AS n FROM ranked UNION ALL SELECT 'ingested', count(*) FROM obs
 UNION ALL SELECT 'rejected', count(*) FROM ranked WHERE reason IS NOT NULL UNION ALL SELECT 'reason:' || reason, count(*) FROM ranked WHERE reason IS NOT NULL GROUP BY reason"""))
def _(spark, sf):
    obs, rej = X.normalized(spark, sf)
    return I.ingest_counters(X.raw_observations(spark, sf), obs, rej)


@query("rejection_summary", with_("norm", "SELECT reason, count(*) AS n FROM ranked WHERE reason IS NOT NULL GROUP BY reason"))
def _(spark, sf):
    return X.normalized(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("encode_cell", with_("points", "SELECT user_id, cell_id FROM u_cells"))
def _(spark, sf):
    s = F.floor(F.col("user_id") / 3)
    p = X.table(spark, sf, "events").select("user_id").distinct().select(
        "user_id", F.round(36.0 + 3.5 * X.frac(s * 0.61803398875) + 0.012 * (F.col("user_id") % 3), 6).alias("lon"),
        F.round(46.8 + 2.7 * X.frac(s * 0.75487766625), 6).alias("lat"))
    return cells.with_cell(p, "lon", "lat").select("user_id", "cell_id")


@query("cell_centroid", with_("centroids", """SELECT cell_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(sw_lon, 6) AS sw_lon,
 round(sw_lat, 6) AS sw_lat, round(step_lon, 8) AS step_lon FROM cen"""))
def _(spark, sf):
    c = cells.with_centroid(X.grid_of(spark, sf))
    return c.select("cell_id", *[F.round(x, 6).alias(x) for x in ("lon", "lat", "sw_lon", "sw_lat")], F.round("step_lon", 8).alias("step_lon"))


TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[A-Za-zА-Яа-яЇїІіЄєҐґ]{{3,}}'), lambda x: x NOT IN ({stop})))"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)
JOINED_SQL = "array_to_string(regexp_extract_all(lower({t}), '[A-Za-zА-Яа-яЇїІіЄєҐґ]{{3,}}'), ' ')"
GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(length({j}) - 1, 1)), lambda i: substr({j}, i, 3)))"


def tokens_sql(t):
    return TOKENS_SQL.format(t=t, stop=STOP_SQL)


@query("text_features", f"""WITH d AS (SELECT doc_id, text, {JOINED_SQL.format(t='text')} AS j FROM documents)
 SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, len({GRAMS_SQL.format(j='j')}) AS n_shingles,
 len(list_distinct(regexp_extract_all(text, '\\d+'))) AS n_numbers FROM d""")
def _(spark, sf):
    d = T.text_features(X.table(spark, sf, "documents"))
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("shingles").alias("n_shingles"), F.size("numbers").alias("n_numbers"))


@query("lexical_similarity", f"""WITH d AS (SELECT doc_id, text, {JOINED_SQL.format(t='text')} AS j FROM documents),
 f AS (SELECT doc_id, {tokens_sql('text')} AS t, {GRAMS_SQL.format(j='j')} AS g, list_distinct(regexp_extract_all(text, '\\d+')) AS n FROM d),
 p AS (SELECT a.doc_id, len(list_intersect(a.t, b.t)) AS ti, len(a.t) + len(b.t) AS tu, len(list_intersect(a.g, b.g)) AS gi, len(a.g) + len(b.g) AS gu,
 len(list_intersect(a.n, b.n)) > 0 AS shared_number FROM f a JOIN f b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, round(CASE WHEN tu = 0 THEN 0 ELSE ti / (tu - ti) END, 6) AS token_jaccard, round(CASE WHEN gu = 0 THEN 0 ELSE gi / (gu - gi) END, 6) AS trigram_jaccard,
 round(0.5 * CASE WHEN tu = 0 THEN 0 ELSE ti / (tu - ti) END + 0.5 * CASE WHEN gu = 0 THEN 0 ELSE gi / (gu - gi) END, 6) AS lexical, shared_number FROM p""")
def _(spark, sf):
    f = T.text_features(X.table(spark, sf, "documents")).select("doc_id", "tokens", "shingles", "numbers")
    a, b = f.alias("a"), f.withColumn("doc_id", F.col("doc_id") - 1).alias("b")
    c = lambda n: F.col(n)
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select(
        c("a.doc_id"), F.round(T.jaccard(c("a.tokens"), c("b.tokens")), 6).alias("token_jaccard"),
        F.round(T.jaccard(c("a.shingles"), c("b.shingles")), 6).alias("trigram_jaccard"),
        F.round(T.lexical_sim(c("a.tokens"), c("b.tokens"), c("a.shingles"), c("b.shingles")), 6).alias("lexical"),
        T.shared_number(c("a.numbers"), c("b.numbers")).alias("shared_number"))


@query("document_content_hash", r"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))) || '|' || source || '|' || '2024-01-31T00') AS content_hash,
 length(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))) AS n FROM documents""")
def _(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", T.content_hash(F.col("text"), F.col("source"), F.lit(X.NOW).cast("timestamp")).alias("content_hash"),
                    F.length(T.normalize_text(F.col("text"))).alias("n"))


@query("hash_embedding", r"""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
 r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ('0x' || substr(h, 2 * (i % 32)::INT + 1, 2))::INT / 127.5::DOUBLE - 1) AS v FROM h),
 n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM r)
 SELECT doc_id, len(v) AS dim, round(list_sum(list_transform(v, lambda x: x / l)), 5) AS total, round(v[1] / l, 6) AS first_value, round(v[33] / l, 6) AS cycled FROM n""")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", T.hash_embedding(F.col("text"), 64).alias("v"))
    return d.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
                    F.round(F.element_at("v", 1), 6).alias("first_value"), F.round(F.element_at("v", 33), 6).alias("cycled"))


@query("cosine_similarity", """SELECT a.vec_id, round(greatest(0, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
 (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = X.table(spark, sf, "embeddings").withColumn("n", T.norm(F.col("embedding")))
    a, b = e.alias("a"), e.withColumn("vec_id", F.col("vec_id") - 1).alias("b")
    return a.join(b, F.col("a.vec_id") == F.col("b.vec_id")).select(
        "a.vec_id", F.round(T.cosine(F.col("a.embedding"), F.col("b.embedding"), F.col("a.n"), F.col("b.n")), 6).alias("cosine"))


# ------------------------------------------------------------------ fusion
COMPAT_SQL = "(CASE WHEN {a} = {b} THEN 1.0 " + " ".join(
    f"WHEN ({{a}} = '{x}' AND {{b}} = '{y}') OR ({{a}} = '{y}' AND {{b}} = '{x}') THEN {v}"
    for x, row in dims.TYPE_COMPAT.items() for y, v in row.items()
    if x in ("strike", "artillery_fire", "explosion", "fire", "building_damaged", "burn_scar")) + f" ELSE {dims.CROSS_TYPE} END)::DOUBLE"
HAV = ("2 * 6371000{D} * asin(least(1, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))")


def hav(a, b):
    return HAV.replace("{D}", D).format(a=a, b=b)


DIST_AB = f"CASE WHEN a.cell_id = b.cell_id THEN 0 ELSE {hav('a', 'b')} END"
FUSE = [  # observation features, links, groups and scored pairs, by brute force within reach
    f"o AS (SELECT obs.* EXCLUDE (lon, lat), cen.lon, cen.lat, epoch(occurred_start) AS s, epoch(occurred_end) AS e, {case('obs_type', WINDOW_H, '12')} * 3600 AS win,"
    f" {case('obs_type', RADIUS_M, '5000')}{D} AS rad, row_number() OVER (ORDER BY obs_id) AS i FROM obs JOIN cen USING (cell_id))",
    "near_cells AS (SELECT a.cell_id AS ca, b.cell_id AS cb, " + DIST_AB + " AS dist FROM cen a JOIN cen b ON abs(a.lat - b.lat) < 0.3 AND abs(a.lon - b.lon) < 0.5)",
    "links AS (SELECT a.i AS a, b.i AS b FROM o a JOIN near_cells n ON n.ca = a.cell_id JOIN o b ON b.cell_id = n.cb AND a.i < b.i"
    " AND greatest(0, b.s - a.e, a.s - b.e) <= greatest(a.win, b.win) AND n.dist <= greatest(a.rad, b.rad)"
    " UNION SELECT a.i, b.i FROM o a JOIN o b ON a.place_id = b.place_id AND a.i < b.i AND greatest(0, b.s - a.e, a.s - b.e) <= greatest(a.win, b.win))",
    "sym AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)",
    "cc(i, g) USING KEY (i) AS (SELECT i, i FROM o UNION SELECT sym.b, min(cc.g) FROM cc JOIN sym ON sym.a = cc.i JOIN recurring.cc AS r ON r.i = sym.b WHERE cc.g < r.g GROUP BY sym.b)",
    "grp AS MATERIALIZED (SELECT o.*, cc.g FROM o JOIN cc USING (i))",
]
SCORE_SQL = [
    f"feat AS (SELECT *, {tokens_sql('text')} AS tok, {JOINED_SQL.format(t='text')} AS j, list_distinct(regexp_extract_all(text, '\\d+')) AS num FROM grp)",
    f"feat2 AS MATERIALIZED (SELECT *, {GRAMS_SQL.format(j='j')} AS gr FROM feat)",
    f"cand AS (SELECT a.obs_id AS obs_a, b.obs_id AS obs_b, a.i AS ia, b.i AS ib, {DIST_AB} AS d, least(a.e, b.e) - greatest(a.s, b.s) AS ov, greatest(a.e, b.e) - least(a.s, b.s) AS un,"
    f" greatest(0, b.s - a.e, a.s - b.e) AS gap, CASE WHEN greatest(a.win, b.win) >= 172800 THEN greatest(a.win, b.win) ELSE 21600 END AS tau,"
    f" 1.5{D} * sqrt(a.geom_precision_m ** 2 + b.geom_precision_m ** 2) AS sig, {COMPAT_SQL.format(a='a.obs_type', b='b.obs_type')} AS s_type,"
    f" a.cell_id = b.cell_id AND a.source_family_id <> b.source_family_id AND a.win >= 172800 AND b.win >= 172800 AS coloc,"
    f" coalesce(a.place_id = b.place_id, false) AS same_place, a.event_id AS ea, b.event_id AS eb"
    f" FROM grp a JOIN grp b ON a.g = b.g AND a.obs_id < b.obs_id)",
    f"cand2 AS (SELECT *, exp(-d / sig) AS s_geo, CASE WHEN ov > 0 THEN ov / un ELSE exp(-gap / tau) END AS s_time FROM cand)",
    # the text factor is only needed where the other three can pass the lower threshold
    f"cand3 AS MATERIALIZED (SELECT c.*, len(list_intersect(a.tok, b.tok)) AS ti, len(a.tok) + len(b.tok) AS tu, len(list_intersect(a.gr, b.gr)) AS gi, len(a.gr) + len(b.gr) AS gu,"
    f" len(list_intersect(a.num, b.num)) > 0 AS same_num FROM cand2 c JOIN feat2 a ON a.i = ia JOIN feat2 b ON b.i = ib"
    f" WHERE s_geo > 0 AND s_time > 0 AND exp((ln(s_geo) + ln(s_time) + ln(s_type)) / 3.6) > 0.38)",
    f"cand4 AS (SELECT *, least(1, 0.5 * CASE WHEN tu = 0 THEN 0 ELSE ti / (tu - ti) END + 0.5 * CASE WHEN gu = 0 THEN 0 ELSE gi / (gu - gi) END"
    f" + CASE WHEN same_place THEN 0.30 ELSE 0 END + CASE WHEN same_num THEN 0.05 ELSE 0 END){D} AS s_text FROM cand3)",
    "cand5 AS (SELECT *, CASE WHEN s_text <= 0 THEN 0 ELSE exp((ln(s_geo) + ln(s_time) + 0.6 * ln(s_text) + ln(s_type)) / 3.6) END AS raw_p FROM cand4)",
    "scored AS MATERIALIZED (SELECT *, CASE WHEN raw_p >= 0.82 THEN 'same' WHEN raw_p <= 0.38 THEN 'different' ELSE 'gray' END AS band, round(raw_p, 6) AS p FROM cand5)",
]
# Verdicts of the fixture: a hit for every gray pair whose event numbers add up to a multiple of 40.
DECIDE_SQL = [
    "gray AS (SELECT *, (ea + eb) % 40 = 0 AS hit FROM scored WHERE band = 'gray' AND NOT coloc)",
    "dec AS MATERIALIZED (SELECT obs_a, obs_b, ia, ib, hit, hit AND (ea + eb) % 80 = 0 AS same, CASE WHEN hit THEN ((7 * least(ea, eb) + 13 * greatest(ea, eb)) % 100) / 100.0 ELSE 0 END AS confidence FROM gray)",
    "flagged AS (SELECT DISTINCT unnest([ia, ib]) AS i FROM dec WHERE NOT hit OR confidence < 0.5)",
    "edges AS (SELECT ia AS a, ib AS b FROM scored WHERE band = 'same' UNION SELECT ia, ib FROM cand WHERE coloc UNION SELECT ia, ib FROM dec WHERE same)",
    "sym2 AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)",
    "c2(i, g) USING KEY (i) AS (SELECT i, i FROM o UNION SELECT sym2.b, min(c2.g) FROM c2 JOIN sym2 ON sym2.a = c2.i JOIN recurring.c2 AS r ON r.i = sym2.b WHERE c2.g < r.g GROUP BY sym2.b)",
    "mem2 AS MATERIALIZED (SELECT o.*, c2.g AS component, flagged.i IS NOT NULL AS needs_check FROM o JOIN c2 USING (i) LEFT JOIN flagged USING (i))",
]


def fixture_verdicts(scored, obs):
    """The fixture's verdict table: one row per hit pair key, from the gray pairs of the run."""
    if "event_id_a" in scored.columns:
        g = scored.withColumnsRenamed({"event_id_a": "ea", "event_id_b": "eb"})
    else:
        e = obs.select("obs_id", "event_id")
        g = (scored.join(e.select(F.col("obs_id").alias("obs_a"), F.col("event_id").alias("ea")), "obs_a")
             .join(e.select(F.col("obs_id").alias("obs_b"), F.col("event_id").alias("eb")), "obs_b"))
    d = FU.gray_pairs(g.where((F.col("ea") + F.col("eb")) % 40 == 0))
    lo, hi = F.least("ea", "eb"), F.greatest("ea", "eb")
    return d.select("pair_key", ((F.col("ea") + F.col("eb")) % 80 == 0).alias("same"), (((7 * lo + 13 * hi) % 100) / 100.0).alias("confidence")).dropDuplicates(["pair_key"])


class Run:
    """A fusion run over the fixture; verdicts are looked up as they would be in a stored cache."""

    def __init__(self, spark, sf):
        from obsweave.session import cut
        obs = X.stored_observations(spark, sf)
        self.grouped = FU.group(obs)
        self.scored = cut(S.scored_pairs(self.grouped, carry=("event_id",)).where("band <> 'different'")
                          .select("obs_a", "obs_b", "hash_a", "hash_b", "type_a", "type_b", "event_id_a", "event_id_b", "band", "colocated"))
        self.verdicts = cut(fixture_verdicts(self.scored, self.grouped))
        self.decisions = FU.adjudicate(FU.gray_pairs(self.scored), self.verdicts)
        edges = (self.scored.where("band = 'same'").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))
                 .unionByName(FU.colocated_edges(self.grouped))
                 .unionByName(self.decisions.where("same").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))))
        self.edges = edges
        self.slim = self.grouped.select("obs_id", "event_id", "theater_id", "user_id", "source_id", "obs_type", "cell_id", "occurred_start", "occurred_end", "geom_precision_m")

    def members(self):
        return FU.propagate(self.slim, self.edges, FU.flagged_obs(self.decisions))

    def events(self):
        m, _ = self.members()
        from obsweave.session import cut
        return FU.build_events(cut(m), X.THEATER)


@query("block_groups", with_("centroids", *FUSE, "SELECT obs_id, min(obs_id) OVER (PARTITION BY g) AS group_first, count(*) OVER (PARTITION BY g) AS group_rows FROM grp", recursive=True))
def _(spark, sf):
    from obsweave.session import cut
    g = cut(B.block(X.stored_observations(spark, sf)).select("obs_id", "group_id", "group_rows"))
    first = g.groupBy("group_id").agg(F.min("obs_id").alias("group_first"))
    return g.join(first, "group_id").select("obs_id", "group_first", "group_rows")


@query("scored_pairs", with_("centroids", *FUSE, *SCORE_SQL, """SELECT obs_a, obs_b, round(s_geo, 4) AS s_geo, round(s_time, 4) AS s_time, round(s_text, 4) AS s_text,
 s_type, p, band, coloc AS colocated FROM scored WHERE band <> 'different'""", recursive=True))
def _(spark, sf):
    g = FU.group(X.stored_observations(spark, sf))
    return S.scored_pairs(g).where("band <> 'different'").select("obs_a", "obs_b", "s_geo", "s_time", "s_text", "s_type", "p", "band", "colocated")


@query("colocated_pairs", with_("centroids", *FUSE, """SELECT min(a.obs_id) OVER (PARTITION BY a.g) AS g, a.cell_id, 0 AS pairs FROM grp a WHERE false UNION ALL
 SELECT g, cell_id, pairs FROM (SELECT (SELECT min(x.obs_id) FROM grp x WHERE x.g = a.g) AS g, a.cell_id, count(*) AS pairs FROM grp a JOIN grp b ON a.g = b.g AND a.cell_id = b.cell_id AND a.i < b.i
 AND a.source_family_id <> b.source_family_id AND a.win >= 172800 AND b.win >= 172800 GROUP BY a.g, a.cell_id)""", recursive=True))
def _(spark, sf):
    from obsweave.session import cut
    grouped = cut(B.block(X.stored_observations(spark, sf)))
    first = grouped.groupBy("group_id").agg(F.min("obs_id").alias("g"))
    return FU.colocated_pair_count(grouped).join(first, "group_id").select("g", "cell_id", "pairs")


@query("adjudicate", with_("centroids", *FUSE, *SCORE_SQL, *DECIDE_SQL, """SELECT obs_a, obs_b, same, round(confidence, 4) AS confidence,
 CASE WHEN hit THEN 'cache' ELSE 'degraded_keep_separate' END AS source, NOT hit OR confidence < 0.5 AS needs_check FROM dec""", recursive=True))
def _(spark, sf):
    return Run(spark, sf).decisions.select("obs_a", "obs_b", "same", F.round("confidence", 4).alias("confidence"), "source", "needs_check")


EVT2 = __import__("obsweave.plans.oracle", fromlist=["x"]).events_from("mem2")


@query("fuse_events", with_("centroids", *FUSE, *SCORE_SQL, *DECIDE_SQL, *EVT2, """SELECT event_id, event_type, cell_id, occurred_start, occurred_end, status, confidence, confidence_band,
 n_sources, n_independent_families, resolved_precision_m, flags FROM evt""", recursive=True))
def _(spark, sf):
    return Run(spark, sf).events().select(
        "event_id", "event_type", "cell_id", "occurred_start", "occurred_end", "status", "confidence", "confidence_band", "n_sources",
        "n_independent_families", "resolved_precision_m", F.array_join("flags", ",").alias("flags"))


@query("predicted_partition", with_("centroids", *FUSE, *SCORE_SQL, *DECIDE_SQL, *EVT2, "SELECT evt.event_id, obs_id FROM m_ JOIN evt USING (component)", recursive=True))
def _(spark, sf):
    from obsweave.operators.evaluate import predicted_partition
    from obsweave.session import cut
    m = cut(Run(spark, sf).members()[0])
    return predicted_partition(m, FU.build_events(m))


@query("fuse_run_counters", with_("centroids", *FUSE, *SCORE_SQL, *DECIDE_SQL, """SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM grp GROUP BY g))::BIGINT AS pairs_seen,
 (SELECT count(DISTINCT g) FROM grp) AS groups, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS degraded_keep_separate FROM dec""", recursive=True))
def _(spark, sf):
    r = Run(spark, sf)
    return FU.run_counters(r.grouped, r.decisions).select("pairs_seen", "groups", "cache_hits", "degraded_keep_separate")


@query("fuse_coverage", with_("norm", "SELECT count(*) AS input, count(*) AS in_events, 0 AS rejected, 0 AS duplicated, 0 AS unaccounted, 0 AS extra, true AS ok FROM obs"))
def _(spark, sf):
    r = Run(spark, sf)
    m, rej = r.members()
    return FU.coverage_audit(r.slim, m, rej)
