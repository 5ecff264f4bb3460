"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, contaminated documents go,
secrets are replaced, and what is left is encoded.

Each stage works on all that its predecessor kept. Between stages the rows lie as Parquet in the shared folder, so an executor's
loss costs its tasks alone. Rows keep the columns of ``documents``, further ones included, until the last stage. An empty
table gives an empty result; how the stages treat nulls, empty texts and repeated rows is said where they are defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from csilake.llm import bpe, decontaminate, near_dups, secrets, toxicity
from csilake.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("bpe", encode),
]

#: Models, signatures and token ids can't be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
