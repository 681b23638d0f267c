"""One query per operator: the driver tables under the project's names, and the results under theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm.common import read
from obsweave.llm import licence_scan, line_windows, manifest, periodic_runs, source_lists, toxicity
from obsweave.llm.contamination import contaminated
from obsweave.llm.disclosure import KINDS, personal_spans
from obsweave.llm.language import identify, train
from obsweave.llm.language_model import model_scores
from obsweave.llm.near_copies import near_copy_groups
from obsweave.llm.packing import pack_windows
from obsweave.llm.vector_codes import nearest_observations


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text observations."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("obs_id"), "text", "lang", F.col("source").alias("source_id"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_groups(observations(spark, sf_dir)).withColumnRenamed("obs_id", "doc_id")


def _host_sql(url: str) -> str:
    raw = rf"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return (f"regexp_extract(translate(regexp_replace({raw}, '^.*@', ''), '{source_lists.CAPITALS}', '{source_lists.SMALL}'), "
            r"'^([^:]*[^:.])\.?(:[0-9]*)?$', 1)")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; a page was fetched on a day of 2024 that follows from its id."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url",
                                               F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")).alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for the hosts, domains and first path parts that pages hold, by their md5.

    Every third host is blocked for some months and again in autumn, some of its paths are allowed
    from May on, and some domains are blocked from a day of the year on.
    """
    url = read(spark, sf_dir, "pages").select(F.coalesce("url", F.lit("")).alias("url"))
    parts = url.select(source_lists.host_of(F.col("url")).alias("host"), F.regexp_extract(source_lists.path_of(F.col("url")), "^/+([^/]+)", 1).alias("part"))
    parts = parts.where("host <> ''").distinct()
    roll = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda c, add: F.date_add(F.lit("2024-01-01").cast("date"), (c % 120 + add).cast("int"))
    hosts = parts.select("host").distinct().withColumn("r", roll(F.col("host")))
    picked = hosts.where("r % 3 = 0")
    change = lambda df, name, scope, value, action, on: df.select(F.lit(name).alias("list_name"), F.lit(scope).alias("scope"), value.alias("value"),
                                                                   F.lit(action).alias("action"), on.alias("listed_on"))
    host = [change(picked, "hosts", "host", F.col("host"), a, day(F.col("r"), n)) for a, n in (("block", 0), ("remove", 90), ("block", 240))]
    paths = parts.where("part <> ''").withColumn("r", roll(F.concat_ws("/", "host", "part"))).where("r % 5 = 0")
    path = change(paths, "paths", "path", F.concat_ws("/", "host", "part"), "allow", day(F.col("r"), 120))
    domains = hosts.select(F.element_at(F.split("host", r"\."), -2).alias("a"), F.element_at(F.split("host", r"\."), -1).alias("b")).where("a is not null")
    domains = domains.select(F.concat_ws(".", "a", "b").alias("value")).distinct().withColumn("r", roll(F.col("value"))).where("r % 2 = 0")
    domain = change(domains, "domains", "domain", F.col("value"), "block", day(F.col("r"), 60))
    out = path.unionByName(domain)
    for x in host:
        out = out.unionByName(x)
    return out


def op1_source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_lists.filter_captures(captures(spark, sf_dir), list_entries(spark, sf_dir)).withColumnRenamed("capture_id", "page_id")


OP1_SQL = rf"""
WITH p AS (SELECT page_id, url, {_host_sql("coalesce(url, '')")} AS host,
                  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
                  DATE '2024-01-01' + (page_id * 7 % 366)::INT AS at FROM pages),
parts AS (SELECT DISTINCT host, regexp_extract(path, '^/+([^/]+)', 1) AS part FROM p WHERE host <> ''),
h AS (SELECT DISTINCT host, ('0x' || md5(host)[1:6])::INT AS r FROM parts),
dom AS (SELECT DISTINCT string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] AS value FROM h WHERE len(string_split(host, '.')) > 1),
d AS (SELECT value, ('0x' || md5(value)[1:6])::INT AS r FROM dom),
pt AS (SELECT host || '/' || part AS value, ('0x' || md5(host || '/' || part)[1:6])::INT AS r FROM parts WHERE part <> ''),
ent AS (SELECT 'hosts' AS l, 'host' AS scope, host AS value, a AS action, DATE '2024-01-01' + (r % 120 + n) AS on_ FROM h, (VALUES ('block', 0), ('remove', 90), ('block', 240)) v(a, n) WHERE r % 3 = 0
        UNION ALL SELECT 'paths', 'path', value, 'allow', DATE '2024-01-01' + (r % 120 + 120) FROM pt WHERE r % 5 = 0
        UNION ALL SELECT 'domains', 'domain', value, 'block', DATE '2024-01-01' + (r % 120 + 60) FROM d WHERE r % 2 = 0),
iv AS (SELECT *, lead(on_) OVER (PARTITION BY l, scope, value ORDER BY on_) AS off_ FROM ent),
m AS (SELECT p.page_id, iv.* FROM p JOIN iv ON p.at >= iv.on_ AND (iv.off_ IS NULL OR p.at < iv.off_) AND iv.action <> 'remove' AND p.host <> ''
      AND ((iv.scope = 'host' AND p.host = iv.value) OR (iv.scope = 'domain' AND ('.' || p.host) LIKE ('%.' || iv.value))
           OR (iv.scope = 'path' AND iv.value = p.host || '/' || regexp_extract(p.path, '^/+([^/]+)', 1)))),
best AS (SELECT page_id, count(*) AS n, min(struct_pack(w := CASE scope WHEN 'path' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, k := -length(value), action := action, l := l, scope := scope, value := value)) AS t
         FROM m GROUP BY page_id)
SELECT p.page_id, p.host, coalesce(t.action, 'none') AS decision, coalesce(n, 0)::BIGINT AS n_entries, t.l || ' ' || t.scope || ' ' || t.value AS decided_by FROM p LEFT JOIN best USING (page_id)
"""


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(observations(spark, sf_dir)).withColumnRenamed("obs_id", "doc_id")


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(observations(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col("obs_id").alias("doc_id"), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.drop_repeated_lines(observations(spark, sf_dir)).withColumnRenamed("obs_id", "doc_id")


def packed(obs: DataFrame) -> DataFrame:
    """Pieces of text observations with what each holds, in windows of the public byte-level vocabulary."""
    import public_tokenizers as P

    pieces = pack_windows(obs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tokenizer_file=P.path("byte_bpe_50k.json"))
    return pieces.select(F.col("obs_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("obs_tokens").alias("doc_tokens"),
                         "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(observations(spark, sf_dir))


def op7_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), "embedding")
    found = nearest_observations(vectors, F.col("obs_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("obs_id").alias("vec_id"), "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return identify(obs, train(obs)).withColumnRenamed("obs_id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    annotations = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "obs_id")
    return toxicity.score(obs, toxicity.train(obs, annotations)).withColumnRenamed("obs_id", "doc_id")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as evaluation incidents."""
    return read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "incident_id")


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(observations(spark, sf_dir), incidents(spark, sf_dir))
    return found.withColumnsRenamed({"obs_id": "doc_id", "incident_id": "item_id"})


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", manifest.CAPITALS, manifest.SMALL)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf_digest(*[docs[c] for c in names[:-1]], lowered))
    log = manifest.observation_manifest(docs, "doc_id", "source", names, carry={"claimed": claimed})
    proofs = manifest.membership_proofs(log, "doc_id", "source")
    folded = manifest.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("proof")), 256).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by crc32 of its id, repeats a passage of its own to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    docs = docs.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return docs.select(F.col("doc_id").alias("obs_id"), F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repetitions(read(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.strongest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(F.col("obs_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(observations(spark, sf_dir)).withColumnRenamed("obs_id", "doc_id")


Q = {
    "op1_source_lists": (op1_source_lists, OP1_SQL),
    "op2_licence_scan": (op2_licence_scan, licence_scan.sql()),
    "op4_line_windows": (op4_line_windows, line_windows.SQL),
    "op10_contamination": (op10_contamination, None),
    "op3_disclosure": (op3_disclosure, None),
    "op5_packing": (op5_packing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op7_vector_codes": (op7_vector_codes, None),
    "op8_language": (op8_language, None),
    "op6_near_copies": (op6_near_copies, None),
    "op13_language_model": (op13_language_model, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op11_manifest": (op11_manifest, manifest.sql()),
}
