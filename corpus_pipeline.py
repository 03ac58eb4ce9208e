"""The training-data pipeline: rules, exact and near duplicates, mix, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

* quality_rules: documents that fail the base rules, or whose lines are mostly
  boilerplate, go. The labels of ``sf_dir`` train the line model.
* exact_dedup: of equal texts the longest original stays, then the least id.
* near_dedup: of each class of near copies the document of the least id stays.
* source_mix: documents repeat, or drop out, as their source's share of the mix asks, in the order of its schedule.
* sentencepiece: one row per document of the mix with its token ids.

Defined results: an empty table passes through every stage; null and empty
texts go in the first; very long texts are taken whole; of rows that tie in
everything one stays; null sources are a source of their own; further columns
of ``documents`` are carried along, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from tripweave.llm.common import ensure_shared_dir
from tripweave.llm.queries import good_labels, model_path, table

#: The line model and the tokens' order of merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    crf = quality_rules.fit(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir))
    return quality_rules.keep_good(docs, crf)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, model_path()), "ids")


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    where = f"{ensure_shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
