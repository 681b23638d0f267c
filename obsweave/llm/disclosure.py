"""Information-theoretic sanitising of personal data in observation texts.

Personal data found by form (addresses, numbers) are the protected entities. A term of a text that
mentions an entity may give the entity away; how much is estimated from the whole corpus. Of an entity's
information IC = -log2 p(entity) a term reveals PMI(term; entity) = log2(p(entity | term) / p(entity)); what is
left to guess is IC - PMI = -log2 p(entity | term) bits, with counts of texts df, p(entity) = df(entity) / N and
p(entity | term) = (df(term, entity) + s * p(entity)) / (df(term) + s): as if s more texts with the term
mentioned the entity by chance, so few texts say less but still count. Terms that leave no more bits than
the first threshold, and reveal a least share of IC, are generalised in every text with the entity; those
that leave no more than the second are removed. The bits left do not hang on N, so the same texts are
treated alike in a small and a large corpus.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from obsweave.llm.common import cut, fields, small_batches

KINDS = ("email", "ip", "card", "phone")
TERM = re.compile(r"[^\W_]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Counted terms held before a task hands them on.
FLUSH_TERMS = 200_000


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches that do not overlap within a kind, in one pass each.

    An address begins where its run of local characters begins, but not before the end of the last
    one; a dotted run of numbers is taken four parts at a time. So no text makes the search go back.
    """
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > last and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append(("email", at, m.end()))
                last = m.end()
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def _free_terms(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Each term of a text with its places, but for those inside a span."""
    taken = sorted((a, b) for _, a, b in spans)
    out: dict[str, list[tuple[int, int]]] = {}
    k = 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b):
            out.setdefault(m.group().lower(), []).append((a, b))
    return out


def _scan(id_kind: pa.DataType):
    """Per text: its spans and, where it has any, its entities and terms. Per task: in how many texts each term occurs."""
    place_t = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    spans_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    terms_t = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(place_t))]))
    names = ["id", "mark", "spans", "entities", "terms", "term", "df"]

    def run(batches):
        counts: Counter = Counter()

        def counted():
            k = len(counts)
            return pa.RecordBatch.from_arrays([pa.nulls(k, id_kind), pa.nulls(k, pa.string()), pa.nulls(k, spans_t), pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, terms_t),
                                               pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=names)
        for batch in batches:
            spans, entities, terms = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                entities.append(sorted({_entity(k, text[a:b]) for k, a, b in found}))
                free = _free_terms(text, found) if found else {}
                terms.append([{"term": t, "places": [{"start": a, "end": b} for a, b in at]} for t, at in free.items()])
                counts.update({t.lower() for t in set(TERM.findall(text))})
                if len(counts) > FLUSH_TERMS:
                    yield counted()
                    counts.clear()
            k = len(spans)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(spans, spans_t), pa.array(entities, pa.list_(pa.string())),
                                              pa.array(terms, terms_t), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
        if counts:
            yield counted()
    return run


def _redact(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, found):
        out, at = [], 0
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                gone = s["action"] == "remove"
                out.append(t[at:s["start"]] + ("" if gone else f"<{s['kind']}>"))
            at = max(at, s["end"])
        return "".join(out) + t[at:]
    return pd.Series([one(t or "", found) for t, found in zip(text, spans, strict=True)])


def revealing(texts: DataFrame, df: DataFrame, n_texts: int, least_share: float, generalise_bits: float, remove_bits: float, pseudo: float) -> DataFrame:
    """(mark, j, remove): the terms, by their place in the text's list, that reveal too much of an entity of the text.

    ``texts`` has mark, entities and terms of each text with an entity, ``df`` the texts of each term.
    """
    n = F.lit(float(n_texts))
    mention = texts.select("mark", F.explode("entities").alias("entity"))
    # an entity that all texts mention has no information to reveal
    entity = mention.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity")).where(F.col("df_entity") < n)
    # entities of one text are all with each of its terms: one row stands for those of a text
    mention = (mention.join(entity, "entity").groupBy("mark", F.when(F.col("df_entity") > 1, F.col("entity")).alias("entity"))
               .agg(F.max("df_entity").alias("df_entity")))
    # what is more frequent than the most mentioned entity allows is left out before the texts meet it
    top = entity.agg(F.max("df_entity")).first()[0] or 0
    words = texts.select("mark", F.posexplode("terms").alias("j", "term")).join(df.where(F.col("df") <= (top + pseudo) * 2.0 ** generalise_bits), "term")
    chance = pseudo * F.col("df_entity") / n
    # the two are together in at most df_entity texts, so a term more frequent than this leaves more bits: no pair is lost
    near = F.col("df") <= (F.col("df_entity") + chance) * 2.0 ** generalise_bits - pseudo + 1e-6
    pair = cut(mention.join(words, "mark").where(near).select("mark", "j", "entity", "term", "df", "df_entity"))
    left = -F.log2((F.col("df_both") + chance) / (F.col("df") + pseudo))
    most = F.least(F.lit(generalise_bits), (1 - least_share) * F.log2(n / F.col("df_entity")))
    told = lambda rows: rows.withColumn("left", left).where(F.col("left") <= most).withColumn("remove", F.col("left") <= remove_bits)
    alone = told(pair.where("entity is null").withColumn("df_both", F.lit(1))).select("mark", "j", "remove")
    more = pair.where("entity is not null")
    both = more.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both"), F.max("df").alias("df"), F.max("df_entity").alias("df_entity"))
    reveal = cut(told(both).select("entity", "term", "remove"))
    return alone.unionByName(more.join(reveal, ["entity", "term"]).select("mark", "j", "remove")).groupBy("mark", "j").agg(F.max("remove").alias("remove"))


def _mark() -> Column:
    """A hash of id and text that is wide enough for any number of rows; null and empty differ."""
    return F.md5(F.to_json(F.struct("id", "text")))


def personal_spans(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", least_share: float = 0.6,
                   generalise_bits: float = 1.25, remove_bits: float = 0.5, pseudo_texts: float = 1.0) -> DataFrame:
    """Find what identifies somebody in observation texts.

    Returns one row per input row: obs_id, mark (hash of id and text) and spans: an array of kind,
    start, end (code points, end exclusive) and action. The kinds email, ip, card and phone go by
    their form and are generalised; term is what the corpus shows to reveal one of them, wherever it
    stands in a text that mentions it.

    Every pair of an entity and a term of one text counts, also of one text alone: with one pseudo text a term
    that occurs beside an entity and nowhere else leaves one bit and is generalised; seen so in three texts it
    leaves 0.42 bits and is removed. A term that leaves half of its texts without the entity stays. An entity that all texts mention has no information
    to reveal. Null and empty texts have no spans. Repeated rows get equal results. Null obs_id: kept.
    Other columns are ignored. An empty table gives an empty result. All counts cover all texts; of
    them the driver sees only their number and the most mentions of one entity.
    """
    small_batches(observations.sparkSession)
    rows = fields(observations, id=obs_id, text=text).withColumn("mark", _mark())
    kind = rows.schema["id"].dataType
    span = "struct<kind:string,start:bigint,end:bigint"
    got = cut(rows.select("id", "mark", "text").mapInArrow(
        _scan(to_arrow_type(kind)), f"id {kind.simpleString()}, mark string, spans array<{span}>>, entities array<string>, "
        "terms array<struct<term:string,places:array<struct<start:bigint,end:bigint>>>>, term string, df bigint"))
    texts = got.where("term is null").select("id", "mark", "spans", F.col("terms.places").alias("places"))
    some = cut(got.where("term is null and size(entities) > 0").select("mark", "entities", F.col("terms.term").alias("terms")).dropDuplicates(["mark"])
               .withColumn("row", F.monotonically_increasing_id()))
    df = got.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    df = df.join(some.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    # numbers of the written rows stand for their marks while terms travel
    found = (revealing(some.select(F.col("row").alias("mark"), "entities", "terms"), df, texts.count(), least_share, generalise_bits, remove_bits, pseudo_texts)
             .groupBy(F.col("mark").alias("row")).agg(F.collect_list(F.struct("j", "remove")).alias("hits"))
             .join(some.select("row", "mark"), "row").drop("row"))
    action = lambda h: F.when(h["remove"], "remove").otherwise("generalise")
    term = lambda h: F.transform(F.get("places", h["j"]), lambda p: F.struct(F.lit("term").alias("kind"), p["start"].alias("start"), p["end"].alias("end"), action(h).alias("action")))
    extra = F.sort_array(F.flatten(F.transform("hits", term)))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("generalise").alias("action")))
    none = F.array().cast(f"array<{span},action:string>>")
    return texts.join(found, "mark", "left").select(F.col("id").alias(obs_id), "mark", F.concat(base, F.coalesce(extra, none)).alias("spans"))


def sanitise(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", **how) -> DataFrame:
    """Observation texts without what identifies somebody: obs_id, spans, text_sanitised, one row per input row.

    Generalised spans become ``<kind>``, removed ones nothing; where spans overlap the first one
    stands for them. A null text becomes an empty one. For the rest see ``personal_spans``.
    """
    found = personal_spans(observations, obs_id, text, **how).select("mark", "spans").dropDuplicates(["mark"])
    rows = fields(observations, id=obs_id, text=text).withColumn("mark", _mark())
    redact = F.pandas_udf(_redact, T.StringType())
    return rows.join(found, "mark").select(F.col("id").alias(obs_id), "spans", redact("text", "spans").alias("text_sanitised"))
