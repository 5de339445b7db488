"""Corpus pipeline: toxicity, language, near-duplicates, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import language, neardup, packing, toxicity
from palimpsest.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("language_id", language.keep_known_languages),
    ("near_duplicates", neardup.drop_near_duplicates),
    ("packing", packing.pack_documents),
]

#: A trained network, context trees, sampled signatures and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
