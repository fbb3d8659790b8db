"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents
(doc_id, text, lang, source, n_chars); further columns of the input are left out. In all of
them a document is a doc_id (null or not) with a text, so rows that share a doc_id but not the text are
judged apart. Null and empty texts are rejected by the quality rules; texts that become empty by line dedup go on and are
packed as an end id. Repeated rows: one stays after near dedup. Rows with a null doc_id are near duplicates of nothing.
Very long texts are read whole. Stages that run Python read rows in batches of 8 MB, as workers of several stages share an executor. Ties are told in the operators' modules. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import Workspace, small_batches, table
from tagloom.llm.decontaminate import decontaminate
from tagloom.llm.line_dedup import remove_cross_site_lines
from tagloom.llm.near_dedup import drop_near_duplicates
from tagloom.llm.packing import pack
from tagloom.llm.quality_rules import keep_good
from tagloom.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    with small_batches(spark):
        return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sites."""
    return remove_cross_site_lines(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    with small_batches(spark):
        return drop_near_duplicates(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of eight words or more."""
    with small_batches(spark):
        return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    with small_batches(spark):
        return pack(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# perplexity, tokens and greedy packing can't be told in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on the written table of the one before."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir).select(*[F.col(c) for c in COLUMNS]), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
