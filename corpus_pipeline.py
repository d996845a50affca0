"""The corpus pipeline: each stage's operator applied to what its predecessor kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, but for the
last, which returns where each piece of each document lies in the packed
sequences. No SQL can express the stages' models and sketches; tests compare
them with brute force.

Defined results: a null or empty text gets a score like any other, keeps its (no)
lines, has no near copies and no benchmark text, and is packed as the end token
alone; a null doc_id has no label, comes first among equal lines, is kept by the
near-duplicate stage and packed under null; rows that repeat are judged and edited
alike, kept or dropped together, and packed each; of equal documents that with the
smallest doc_id stays; a document that loses all its words to line dedup goes; empty
documents, labels or benchmark tables give what is left without them (no documents:
no rows; no labels: every score is 0.5, which passes); a very long text is one row in
every stage and is cut by the last; columns that the stages do not know pass through
all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import common, decontaminate, linedup, neardup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those with nothing left go."""
    return linedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bestfit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as a table and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
