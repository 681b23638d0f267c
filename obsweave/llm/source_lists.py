"""Temporal lists of web addresses: each capture against the entries that were active when it was fetched.

The project's sources carry an address each but no lists or captures, so this is general: captures
are (capture_id, url, fetched_at), list entries are dated changes (list_name, scope, value, action,
listed_on) of hosts, domains or paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsweave.llm.common import cut, fields

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and closing dot; empty where there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_extract(F.translate(F.regexp_replace(raw, r"^.*@", ""), CAPITALS, SMALL), r"^([^:]*[^:.])\.?(:[0-9]*)?$", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def depths(entries: DataFrame) -> dict[str, list[int]]:
    """The numbers of labels of all domain entries and of path parts of all path entries."""
    size = F.when(F.col("scope") == "domain", F.size(F.split("value", r"\."))).when(F.col("scope") == "path", F.size(_parts(F.col("value"))) - 1)
    found = entries.select("scope", size.alias("n")).where("n > 0").distinct().collect()
    return {scope: sorted(r["n"] for r in found if r["scope"] == scope) for scope in ("domain", "path")}


def _keys(host: Column, path: Column, tried: dict[str, list[int]]) -> Column:
    """(scope, value) pairs under which an entry can mean this address: its host, and its domains and path prefixes of the depths tried."""
    labels, parts = F.split(host, r"\."), _parts(path)
    pair = lambda scope, value: F.struct(F.lit(scope).alias("scope"), value.alias("value"))
    upto = lambda scope, size: F.filter(F.array(*map(F.lit, tried[scope])).cast("array<int>"), lambda n: n <= size)
    domains = F.transform(upto("domain", F.size(labels)), lambda n: pair("domain", F.array_join(F.slice(labels, -n, n), ".")))
    paths = F.transform(upto("path", F.size(parts)), lambda n: pair("path", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))
    return F.when(host != "", F.concat(F.array(pair("host", host)), domains, paths))


def entry_value(scope: Column, value: Column) -> Column:
    """An entry's value as the addresses it is compared with: host in lower case without dots at its ends, path parts without empty ones."""
    host = F.regexp_replace(F.translate(F.regexp_extract(value, r"^([^/]*)", 1), CAPITALS, SMALL), r"^\.+|\.+$", "")
    path = _parts(F.regexp_extract(value, r"^[^/]*(/.*)$", 1))
    return F.when(scope == "path", F.array_join(F.concat(F.array(host), path), "/")).otherwise(host)


def validity(entries: DataFrame) -> DataFrame:
    """Dated changes of an entry as intervals [valid_from, valid_to) with one action each; ``remove`` ends one.

    Values that mean the same (``EX.com`` and ``.ex.com``, ``ex.com/a`` and ``ex.com//a/``) are one entry.
    Changes of one entry on one day: the last action by name stands.
    """
    e = (fields(entries, list_name="list_name", scope="scope", value="value", action="action", listed_on="listed_on")
         .where("list_name is not null and scope is not null and value is not null and action is not null and listed_on is not null")
         .withColumn("value", entry_value(F.col("scope"), F.col("value"))).groupBy("list_name", "scope", "value", "listed_on").agg(F.max("action").alias("action")))
    own = W.partitionBy("list_name", "scope", "value").orderBy("listed_on")
    return (e.withColumn("valid_to", F.lead("listed_on").over(own)).where("action <> 'remove'")
            .select("list_name", "scope", "value", "action", F.col("listed_on").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, capture_id: str = "capture_id", url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Decide for each capture by the list entries active at its fetch time.

    Entries are changes: list_name, scope (host: that host; domain: it and all below; path: host and
    leading path parts), value, action (block, allow or remove), listed_on. Returns one row per input
    row: capture_id, host, decision (block, allow, or none where no entry is active), n_entries,
    decided_by (list, scope and value of the deciding entry). The narrowest entry decides: path before
    host before domain, then the longer value, then allow before block, then the names' order.

    Null addresses or ones without a host have an empty host and no decision; a null fetch time meets no
    interval. Repeated captures are decided alike, rows of one id that differ each for themselves. Other
    columns are ignored. Empty tables give no rows or no decisions. An address is tried under the depths
    (labels, path parts) that occur in the entries, whatever they are; the driver sees those numbers. A host with a third of all
    captures: the addresses of a host and day are told apart before the join, and its partition is split by AQE.
    """
    rows = fields(captures, id=capture_id, url=url, at=fetched_at).select("id", "url", "at", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    spans = cut(validity(entries))
    keys = _keys(F.col("host"), F.col("path"), depths(spans))
    # what decides is the address up to the deepest entry and the time: equal ones meet the lists once
    asked = rows.select(keys.alias("keys"), "at").where("keys is not null and at is not null")
    asked = asked.select(F.explode("keys").alias("key"), "at").select("key.*", "at").distinct()
    met = asked.join(spans, ["scope", "value"]).where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    width = F.when(F.col("scope") == "path", 0).when(F.col("scope") == "host", 1).otherwise(2)
    order = F.struct(width.alias("w"), (-F.length("value")).alias("l"), "action", "list_name", "scope", "value")
    key = met.groupBy("scope", "value", "at").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("n"))
    hit = (rows.select("id", "url", "at", F.explode(keys).alias("key")).select("id", "url", "at", "key.*")
           .join(key, ["scope", "value", "at"]).groupBy("id", "url", "at").agg(F.min("top").alias("top"), F.countDistinct("scope", "value").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")))
    # repeated rows counted their entries as often as they come
    hit = hit.select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("at").alias("t"), "top", (F.col("n") * F.col("k") / F.col("c")).cast("long").alias("n"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")) & F.col("at").eqNullSafe(F.col("t"))
    return rows.join(hit, same, "left").select(
        F.col("id").alias(capture_id), "host", F.coalesce("top.action", F.lit("none")).alias("decision"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.when(F.col("top").isNotNull(), F.concat_ws(" ", "top.list_name", "top.scope", "top.value")).alias("decided_by"))
