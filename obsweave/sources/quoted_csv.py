"""CSV files whose quoted fields may hold line ends, read by many tasks.

Spark's text source cuts a file into blocks at line ends. Whether a block begins inside quotes follows
from the number of quotes before it, so a first look counts the quotes of every block. The second look
then puts lines together within a block; what a block boundary cuts in two is joined afterwards. No
task reads more than its blocks, and only the pieces at boundaries are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECES = "file_path string, start long, line long, piece string, text string"


def _pieces(batches):
    """Rows (file_path, start, line, piece, text): whole records, and the pieces of cut ones (``head``, ``middle``, ``tail``)."""
    state = {"key": None, "open": False, "held": [], "line": 0, "cut": False}
    out: list[tuple] = []

    def put(kind: str) -> None:
        out.append((*state["key"], state["line"], kind, "\n".join(state["held"])))
        state["held"] = []

    def finish() -> None:
        if state["key"] is not None and state["held"]:
            put("middle" if state["cut"] else "head")

    def flush():
        nonlocal out
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                          names=["file_path", "start", "line", "piece", "text"])

    for batch in batches:
        odd = [n % 2 for n in pc.count_substring(batch.column("value"), '"').to_pylist()]
        for path, start, inside, value, turn in zip(batch.column("file_path").to_pylist(), batch.column("start").to_pylist(), batch.column("inside").to_pylist(),
                                                    batch.column("value").to_pylist(), odd, strict=True):
            if (path, start) != state["key"]:
                finish()
                state.update(key=(path, start), open=inside, held=[], line=0, cut=inside)
            state["held"].append(value)
            state["open"] ^= bool(turn)
            if not state["open"]:
                put("tail" if state["cut"] else "whole")
                state["cut"] = False
                state["line"] += 1
        yield flush()
    finish()
    yield flush()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, start, line, text): every record of the files, in the order of (start, line) within a file, the header too."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))
    quotes = lines.groupBy("file_path", "start").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("n"))
    before = W.partitionBy("file_path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = quotes.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).where("inside").select("file_path", "start", "inside")
    # at most one row per block of the files
    marked = lines.join(F.broadcast(inside), ["file_path", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    got = marked.select("file_path", "start", "inside", "value").mapInArrow(_pieces, PIECES)
    whole = got.where("piece = 'whole'").drop("piece")
    # a head begins a record; what follows it up to the next head belongs to it
    cut = got.where("piece <> 'whole'").withColumn("n", F.sum(F.when(F.col("piece") == "head", 1).otherwise(0)).over(W.partitionBy("file_path").orderBy("start", F.desc(F.col("piece") == "tail"))))
    joined = cut.groupBy("file_path", "n").agg(F.array_sort(F.collect_list(F.struct("start", F.when(F.col("piece") == "tail", 0).otherwise(1).alias("turn"), "line", "text"))).alias("p"))
    first = F.element_at(F.filter("p", lambda x: x["turn"] == 1), 1)
    return whole.unionByName(joined.select("file_path", F.coalesce(first["start"], F.col("p")[0]["start"]).alias("start"), F.coalesce(first["line"], F.col("p")[0]["line"]).alias("line"),
                                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))


def read_quoted_csv(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """CSV with a header in every file (the names of each file's own header count); all columns are text.

    Empty fields are null, quotes inside quotes are doubled. With ``positions`` the columns ``file_path``,
    ``start`` and ``line`` tell where a record stands. Files may have other columns or another order.
    """
    records = csv_records(spark, path).where("text <> ''")
    heads = records.where("start = 0 and line = 0").select("file_path", F.col("text").alias("head"))
    # one header per file; files of one header are read together
    layouts = heads.groupBy("head").agg(F.min("file_path").alias("one")).orderBy("one").collect()
    body = records.where("not (start = 0 and line = 0)").join(F.broadcast(heads), "file_path")
    out = None
    for r in layouts:
        names = spark.createDataFrame([(r["head"],)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(r["head"].count(",") + 1)), {"escape": '"'}).alias("r")).first()["r"]
        names = [n for n in names if n is not None]
        schema = ", ".join(f"`{n.strip()}` string" for n in names)
        part = body.where(F.col("head") == r["head"]).withColumn("r", F.from_csv("text", schema, {"escape": '"'}))
        part = part.select(*(["file_path", "start", "line"] if positions else []), "r.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "file_path string, start long, line long" if positions else "file_path string")
    return out
