"""Corpus pipeline over ``documents``: each stage calls one operator of rateflow.llm.

quality (positive-unlabelled classifier; rejected documents go), simhash (one document of each
near-duplicate group stays), decontaminate (documents that hold a benchmark item go), pii
(pseudonyms in the text), packing (pieces of sequences). All but the last return the columns of
their input. Null text counts as empty; repeated rows are near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rateflow.llm import common, packing, pii, pu_quality, simhash, templates, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, 4, 4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.clean(docs, common.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, spark.conf.get(PII_KEY, "test key, not secret"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "byte_bpe_50k.json", tokens.BLANKS, 1)


#: Session setting with the secret key of the pseudonyms; unset, a key for tests is used.
PII_KEY = "spark.rateflow.pii.key"

STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", private),
    ("packing", packed),
]

#: Learned models and tokenizers decide the rows, so SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
