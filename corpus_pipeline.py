"""The corpus pipeline: toxic documents go, one document of each group of near duplicates
stays, passages that repeat across documents are cut out, and the rest is packed.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs``.  ``run`` stores each stage's rows in the shared folder before the next reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common, jaccard, packing, substrings, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the
    labelled ones among ``docs``."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; rows
    without id stay, and of several rows under one id one stays."""
    found = common.stored(jaccard.similar_components(docs), "components").where("doc_id is not null")
    counted = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    gone = counted.where("doc_id <> component_id").select("doc_id")
    twice = counted.where("doc_id = component_id and rows > 1").select("doc_id")
    once = docs.join(common.small(gone.unionByName(twice)), "doc_id", "left_anti")
    one = docs.join(common.small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(one)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that one of smaller id has."""
    kept = substrings.without_passages(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]
# Trained scores, rolling hashes and bin packing have no SQL form; tests hold the stages
# against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
