"""The corpus pipeline: five operators over the documents, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of documents.

1. quality_rules: rows that the base rule or the learned list rejects go.
2. jaccard_join: of each component of linked documents the one with the
   smallest doc_id stays, once.
3. decontamination: contaminated documents go.
4. pii: personal data in text is replaced by the name of its kind.
5. mixing: sizes, targets and words taken of what is left.

Stages 1, 4 and 5 rest on learned rules or on hashes that SQL engines do not
share, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenry.llm import decontamination, jaccard_join, mixing, pii, quality_rules
from lumenry.llm.workspace import tidied, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = _table(spark, sf_dir, "documents")
    *first, last = STAGES[:-1]
    with tidied(spark):  # only the table that the last stage reads stays
        for name, stage in first:
            with tidied(spark):
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        docs = written(last[1](spark, docs, sf_dir), f"stage-{last[0]}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
