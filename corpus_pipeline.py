"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and
reads it again as the next stage's documents.  All stages take nulls in any column, repeated rows, texts of
any length, further columns and empty tables; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgen.llm import decontaminate, lines, neardup, packing, quality
from relgen.llm.tables import apart, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null, empty and wordless texts fail the base rule (under 20 words) and go; a null lang is a stratum of
    its own; rows without a doc_id have no label but are judged; repeated rows stay or go together.
    """
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, however short; one that held nothing else goes.

    Null and empty texts and rows without a doc_id are left as they are; a null source is a site of its own;
    of documents that share a line the least doc_id keeps it, in all of its rows.  n_chars follows the text.
    """
    own, back = apart(docs, ("doc_id", "text", "source", "n_chars"))
    out = lines.remove_boilerplate(own, min_words=1).where("lines_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, linked at a similarity of 0.8 or more.

    The least doc_id of a group stays, with all rows that repeat it; null, empty and wordless texts link
    with nothing and stay, as do rows without a doc_id.
    """
    gone = neardup.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows are judged by their texts alone: null and empty ones stay, repeated ones stay or go together; items
    without an id or a text are not sought.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; the only stage without documents' columns.

    Null and empty texts are the end token alone; repeated rows and rows without a doc_id are packed each.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Alignment and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
