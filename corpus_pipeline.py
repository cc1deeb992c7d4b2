"""Corpus pipeline: toxicity, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table, written
from strandloom.llm.content_sort import drop_exact_duplicates
from strandloom.llm.near_jaccard import near_components
from strandloom.llm.packing import pack_documents
from strandloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, fitted on the labels that aren't held out.

    Null texts are empty, empty ones get the bias's score; rows with a null id are scored and kept or rejected like any; repeated rows go
    together; very long texts are hashed in chunks; all columns pass through; an empty table, or one without labelled rows, loses nothing.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are equal up to white space.

    Null and empty texts are equal; null ids sort last, so such a row stays only where no other has its text; of repeated rows one stays;
    very long texts are compared whole; all columns pass through; an empty table gives none.
    """
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each similarity class; rows without an id are in no class and stay.

    Null and empty texts link with nothing and stay; repeated rows are in one class and stay or go together; very long texts are compared
    whole; all columns pass through; an empty table gives none.
    """
    classes = near_components(docs)
    stay = classes.where("component_id IS NULL OR component_id = doc_id").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay._stay), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 8192 bytes for every part of every document.

    Null texts have length 0 and a place; null ids and sources are packed, the latter without conflicts; repeated rows get a place each; texts
    longer than a bin are cut into pieces; other columns are ignored; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("packing", packing)]
#: The fitted model of the first stage and best-fit bins are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
