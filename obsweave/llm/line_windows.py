"""Repeated passages of lines across observation texts: overlapping windows of three lines.

Every three consecutive lines that are not blank are hashed to 128 bits. Hashes that occur more than
once anywhere are found by a count that is combined in the map tasks, so a window in a third of all
texts costs a row per task. The first occurrence, by obs_id, hash of the text and place, stays; the lines that later
ones cover are merged and taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import cut, fields

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _full_lines(lines: Column) -> Column:
    """(place, line without surrounding blanks) of the lines that are not blank."""
    bare = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANKS)).alias("t")))
    return F.filter(bare, lambda s: s["t"] != "")


def drop_repeated_lines(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", window: int = 3,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Take repeated runs of ``window`` lines out of observation texts.

    Returns obs_id, text (what is left, lines joined again), n_lines (lines before) and n_removed, one
    row per input row. Blank lines are in no window and stay. A run counts as repeated when its lines,
    without blanks around them, come again in the same order in any text or later in the same one; where a repetition overlaps
    the first occurrence in its own text, only the lines behind that go.

    Null text: stays null, no lines. Texts with fewer full lines than ``window`` stay as they are. Rows
    of one obs_id and one text are the same text and stay alike; rows of one obs_id, or of none, with
    several texts are each a text of their own, ordered by a hash of it. A null obs_id comes first. Of the other columns those named in ``keep`` are
    carried along. An empty table gives an
    empty result. No group of windows or texts is gathered; only the covered places of one text are.
    """
    rows = fields(observations, id=obs_id, text=text, **{f"keep_{i}": c for i, c in enumerate(keep)}).withColumn("mark", F.xxhash64("text"))
    full = rows.where(F.col("text").contains("\n")).select("id", "mark", _full_lines(_lines(F.col("text"))).alias("l")).where(F.size("l") >= window)
    part = lambda k, seed: F.xxhash64(F.lit(seed), *[F.element_at("l", k + 1 + d)["t"] for d in range(window)])
    spots = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda k: F.struct(k.alias("k"), part(k, 1).alias("h1"), part(k, 2).alias("h2")))
    windows = cut(full.select("id", "mark", F.explode(spots).alias("w")).select("id", "mark", "w.*"))
    again = cut(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    hits = cut(windows.join(again, ["h1", "h2"]))
    first = cut(hits.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "k")).alias("first")))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    later = (hits.join(first, ["h1", "h2"]).where(~(own & (F.col("k") == F.col("first.k"))))
             .select("id", "mark", F.when(own, F.greatest("k", F.col("first.k") + window)).otherwise(F.col("k")).alias("a"), (F.col("k") + window - 1).alias("b")).where("a <= b"))
    covered = later.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("runs")).select(F.col("id").alias("at"), F.col("mark").alias("at_mark"), "runs")
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"]))))
    joined = rows.join(covered, F.col("id").eqNullSafe(F.col("at")) & (F.col("mark") == F.col("at_mark")), "left").withColumn("lines", _lines(F.col("text")))
    gone = joined.withColumn("l", F.when(F.col("runs").isNotNull(), _full_lines(F.col("lines"))))
    gone = gone.withColumn("gone", F.when(F.col("runs").isNotNull(), F.filter(F.transform(places, lambda k: F.get("l", k)["i"]), lambda i: i.isNotNull())))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    return gone.select(F.col("id").alias(obs_id), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                       F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                       *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


#: The same rule for the documents table, windows compared by their lines.
SQL = r"""
WITH src AS (SELECT DISTINCT doc_id, text FROM documents),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM src WHERE text IS NOT NULL),
lines AS (SELECT doc_id, u.i AS i, trim(a[u.i], ' ' || chr(9) || chr(13)) AS t
          FROM parts, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) u),
num AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE t <> ''),
win AS (SELECT doc_id, k, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS g
        FROM num WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
fst AS (SELECT g, min(struct_pack(d := doc_id, k := k)) AS f FROM win WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
run AS (SELECT w.doc_id, CASE WHEN w.doc_id = f.d THEN greatest(w.k, f.k + 3) ELSE w.k END AS a, w.k + 2 AS b
        FROM win w JOIN fst USING (g) WHERE NOT (w.doc_id = f.d AND w.k = f.k)),
gone AS (SELECT DISTINCT n.doc_id, n.i FROM num n JOIN run r ON n.doc_id = r.doc_id AND n.k BETWEEN r.a AND r.b),
cut AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g IS NULL THEN d.text ELSE coalesce(array_to_string([x for x, i in string_split(d.text, chr(10)) if NOT list_contains(g, i)], chr(10)), '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cut USING (doc_id)
"""
