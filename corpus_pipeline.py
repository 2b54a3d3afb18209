"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. quality: documents that the rule ensemble rejects go (operator 6)
2. near_duplicates: of documents whose five-word shingles have a Jaccard similarity of 0.8 or more one stays (operator 9)
3. decontaminate: documents with benchmark passages go (operator 7)
4. mix: documents are repeated or left out to meet the sources' weights (operator 3)
5. tokens: ids are written as a compressed dataset; its index is returned (operator 1)

The first four return the columns of their input, whatever their names.

Defined cases, in every stage: a null text is an empty one; a null doc_id is an
id like any other and comes last where one of a group is chosen (first where ids
are ordered); rows that repeat are scored, judged, mixed and encoded each for
itself, and of equal ones near_duplicates keeps one; ties go to the smaller id,
then to hashes of text and row, so that runs agree; long texts are read whole;
an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, quality, simhash, tokenstore
from tidemark.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.store(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]
#: Tokenizing, fitting a classifier and XXH64 fingerprints are beyond DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
