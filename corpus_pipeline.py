"""Corpus pipeline: language ID, line dedup, near-copy join, decontamination, packing.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm.common import cut, read, stage
from obsweave.llm.contamination import uncontaminated
from obsweave.llm.language import identify, train
from obsweave.llm.line_windows import drop_repeated_lines
from obsweave.llm.near_copies import near_copy_groups, one_of_each
from obsweave.llm.queries import packed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the nearest-centroid model accepts; each row is judged by its own text and never moved.

    Null and empty texts and texts without letters go. Repeated rows stay alike; null ids are rows like others.
    """
    docs = docs.select(*COLUMNS)
    found = identify(docs, train(docs, "doc_id"), "doc_id", keep=COLUMNS)
    return found.where("not rejected").select(*COLUMNS)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; a document of which no full line is left goes.

    A text without repeated windows stays as it is, a null or empty one too; rows of one id and one text lose the same lines.
    """
    kept = drop_repeated_lines(docs.select(*COLUMNS), "doc_id", keep=("lang", "source"))
    return (kept.where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \t\r\n")) != ""))
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five words, similarity 0.8).

    Texts without words, and rows without an id, are alone and stay. Of rows of one id one stays, that of the least text.
    """
    docs = docs.select(*COLUMNS)
    return one_of_each(docs, cut(near_copy_groups(docs, "doc_id", width=5, percent=80)), "doc_id")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item comes back; each row is judged by its own text, null and empty ones stay."""
    return uncontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), incident_id="item_id")


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows with what each holds; null and empty texts are an end id, repeated rows are packed as often as they come."""
    return packed(docs.select(F.col("doc_id").alias("obs_id"), "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language ID and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = cut(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
