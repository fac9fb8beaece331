"""A training corpus from raw documents: classify, dedup exactly, dedup nearly, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of ``documents``, of which there may be more
than those named here, called anything: operators box whole rows.

Defined cases, for every stage: no rows give no rows; a null text is an empty one; rows without an id, and rows that
repeat, are rows like others; very long texts are read whole.  What that means for the result is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massloom.llm import exact_dedup, mixing, packing, quality, simhash_jaccard
from massloom.session import delete_path, fresh_path, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Without labels of both classes all stay.  Null and empty texts are scored like others; rows alike in id, text and metadata
    fare alike.
    """
    scored = quality.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_documents(docs, scored)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of texts that are equal but for white space stays: the longest original, then the least id.

    Null, empty and blank texts are equal to each other.  Of rows that repeat id and length one stays.
    """
    return exact_dedup.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id (null last).

    Candidates come from SimHash fingerprints within 11 of 64 bits, links are those whose 5-word shingles have a Jaccard
    similarity of at least 0.8; groups are their components.  Documents without words are one group; of rows that repeat one stays.
    """
    return simhash_jaccard.one_of_each(docs, threshold=0.8, width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    A null source is a source of its own; documents without words are not taken; of rows alike in id, size and source all
    are taken as often as the one that is taken most.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of the context-size tiers; every token of every row is in one piece.

    A document without words is its end id alone.
    """
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_path(spark, last)
        last = path
    return docs
