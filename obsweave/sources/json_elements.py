"""The objects of one top-level array of large JSON files, read by many tasks.

Spark's text source cuts a file into blocks at closing braces. Whether a block begins inside a string, how
deep it begins and in which array follow from the blocks before it, so a first look takes these changes of
every block, once for each way it may begin. The second look then cuts the objects out; what a block
boundary parts is joined afterwards. No task reads more than its blocks, and only the objects at
boundaries are shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What lies outside strings up to an opening brace or an open string, whole strings included; what lies inside up to the closing quote.
OUTSIDE = re.compile(r'(?:[^"{\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+', re.S)
INSIDE = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)
NAME = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[$')
#: Characters before an object in which the name of its array stands.
REACH = 4096
BLOCKS = "file_path string, start long, root string, turns boolean, change array<struct<delta:long,low:long,names:map<long,string>>>"
PIECES = "file_path string, start long, opened long, line long, piece string, text string"


class Braces:
    """Objects that open and close outside strings, chunk by chunk; a chunk ends before a closing brace."""

    def __init__(self, inside: bool):
        self.inside, self.held = inside, ""

    def events(self, text: str):
        """(place, what stands before it) of an opening brace, (place, None) of a closing one."""
        last, at, end = 0, 0, len(text)
        while at < end:
            at = (INSIDE if self.inside else OUTSIDE).match(text, at).end()
            if at == end or text[at] == "\\":  # an escape ends within the chunk, so a last backslash is none
                break
            if text[at] == '"':
                self.inside = not self.inside
            else:
                yield at, (self.held + text[max(last, at - REACH):at])[-REACH:]
                self.held, last = "", at + 1
            at += 1
        if self.inside:
            self.held = (self.held + text[max(last, len(text) - REACH):] + "}")[-REACH:]
        else:
            self.held = ""
            yield len(text), None


def array_name(before: str) -> str | None:
    """The array whose first object follows; none for an object that goes on in its array, empty for others."""
    before = before.rstrip()
    if before.endswith(","):
        return None
    m = NAME.search(before)
    return m.group(1) if m else ""


def _changes(batches):
    """What each block changes, for a begin outside and inside a string."""
    key, root, ways = None, "", []

    def row():
        change = [{"delta": w["depth"], "low": w["low"], "names": list(w["names"].items())} for w in ways]
        return pa.RecordBatch.from_pylist([{"file_path": key[0], "start": key[1], "root": root, "turns": ways[0]["braces"].inside, "change": change}], schema=schema)

    change_t = pa.list_(pa.struct([("delta", pa.int64()), ("low", pa.int64()), ("names", pa.map_(pa.int64(), pa.string()))]))
    schema = pa.schema([("file_path", pa.string()), ("start", pa.int64()), ("root", pa.string()), ("turns", pa.bool_()), ("change", change_t)])
    for batch in batches:
        for path, start, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "start", "value")), strict=True):
            if (path, start) != key:
                if key is not None:
                    yield row()
                key, root = (path, start), text.lstrip("\ufeff \t\r\n")[:1] if start == 0 else ""
                ways = [{"braces": Braces(inside), "depth": 0, "low": 0, "names": {}} for inside in (False, True)]
            for w in ways:
                for _, before in w["braces"].events(text):
                    if before is None:
                        w["depth"] -= 1
                        w["low"] = min(w["low"], w["depth"])
                    else:
                        # the array's level is at most one above where the block begins
                        if w["depth"] <= 1 and (name := array_name(before)) is not None:
                            w["names"][w["depth"]] = name
                        w["depth"] += 1
    if key is not None:
        yield row()


def _objects(wanted: str):
    """Objects of the wanted array: whole ones, and the pieces of those that a block boundary parts."""
    schema = pa.schema([("file_path", pa.string()), ("start", pa.int64()), ("opened", pa.int64()), ("line", pa.int64()), ("piece", pa.string()), ("text", pa.string())])

    def run(batches):
        key, out, s = None, [], {}

        def put(kind: str):
            if s["level"] == 0 or s["name"] == wanted:
                out.append((*key, s["opened"], s["line"], kind, "".join(s["held"])))
            s["held"], s["line"] = [], s["line"] + 1

        def found_rows():
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def finish():
            if key is not None and s["depth"] > s["level"]:
                put("part")

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("file_path", "start", "value", "inside", "depth", "level", "name", "opened"))
            for path, start, text, inside, depth, level, name, opened in zip(*cols, strict=True):
                if (path, start) != key:
                    finish()
                    key, s = (path, start), {"braces": Braces(inside), "depth": depth, "level": level, "name": name, "opened": opened, "held": [], "line": 0, "kind": "part"}
                at = 0
                for place, before in s["braces"].events(text):
                    if before is None:
                        s["depth"] -= 1
                        if s["depth"] == level:
                            s["held"].append(text[at:] + "}")
                            put(s["kind"])
                            at = len(text) + 1
                    else:
                        if s["depth"] == level:
                            if (found := array_name(before)) is not None:
                                s["name"] = found
                            at, s["kind"], s["opened"] = place, "whole", start
                        s["depth"] += 1
                if s["depth"] > level and at <= len(text):
                    s["held"].append(text[at:] + "}")
            yield found_rows()
            out.clear()
        finish()
        yield found_rows()
    return run


def json_elements(spark: SparkSession, path: str, array: str) -> DataFrame:
    """(file_path, start, line, text): each object of the top-level array of that name, as JSON text.

    A file that is itself an array gives all its objects, whatever the name. The order within a file is that of
    (start, line). The array holds objects only; its name has no escapes. Files without it give nothing.
    """
    chunks = spark.read.text(path, lineSep="}").select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))
    blocks = chunks.select("file_path", "start", "value").mapInArrow(_changes, BLOCKS)
    # one row per block of the files
    file = W.partitionBy("file_path").orderBy("start")
    before = file.rowsBetween(W.unboundedPreceding, -1)
    b = blocks.withColumn("inside", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    b = b.withColumn("c", F.get("change", F.col("inside").cast("int"))).withColumn("level", F.when(F.first("root").over(file) == "[", 0).otherwise(1))
    b = b.withColumn("depth", F.coalesce(F.sum("c.delta").over(before), F.lit(0)))
    opens = (F.col("depth") + F.col("c.low") <= F.col("level")) & (F.col("depth") + F.col("c.delta") > F.col("level"))
    b = (b.withColumn("own", F.try_element_at("c.names", F.col("level") - F.col("depth"))).withColumn("name", F.last("own", ignorenulls=True).over(before))
         .withColumn("opened", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(before)))
    marked = chunks.join(F.broadcast(b.select("file_path", "start", "inside", "depth", "level", "name", "opened")), ["file_path", "start"])
    got = marked.select("file_path", "start", "value", "inside", "depth", "level", "name", "opened").mapInArrow(_objects(array), PIECES)
    whole = got.where("piece = 'whole'")
    parts = got.where("piece = 'part'").groupBy("file_path", "opened").agg(F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("p"))
    joined = parts.select("file_path", F.col("opened").alias("start"), F.col("p")[0]["line"].alias("line"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return whole.select("file_path", "start", "line", "text").unionByName(joined)


def read_json_elements(spark: SparkSession, path: str, array: str, schema: str, order: bool = False) -> DataFrame:
    """The objects of the array with the fields of ``schema``; with ``order`` also file_path, start and line."""
    d = json_elements(spark, path, array).withColumn("r", F.from_json("text", schema))
    return d.select(*(["file_path", "start", "line"] if order else []), "r.*")
