"""The corpus pipeline: toxicity, quality, near duplicates, personal data, packing.

Every stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns they were given, whichever they are.

Every decision is made on a row by its own text, never through its doc_id, so rows without a doc_id and
rows that share one are kept or rejected like any other:

* toxicity: a row predicted toxic goes; a null or empty text scores 0 and stays.
* quality: a row that the base rules or the weak supervision reject goes; so do null and empty texts.
* near_duplicates: of linked rows (five-word shingles, a similarity of 0.8) the one of the smallest
  doc_id stays, nulls last; rows equal in doc_id and text stay once; texts without words all stay.
* personal_data: every row stays, its text masked; a null text stays null.
* packing: every row is packed, a null or empty text as a lone separator, with its token ids.

An empty table passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import best_fit_packing, minhash_dedup, personal_data, quality_rules, toxicity
from tidemark.llm.common import forget, table, written


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.good_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.unique_documents(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.best_fit_packing(docs, with_ids=True)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality", of_quality),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Trained and fitted stages are beyond SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now: list[str] = []
            docs = written(docs, name, now)
            forget(before)  # the stage before has been read
            before = now
    return docs
