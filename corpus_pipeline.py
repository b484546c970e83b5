"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import packing, quality, rules, simhash
from stratafold.llm.common import read_table, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    return rules.keep(docs, rules.train(docs, read_table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go."""
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard likeness of five-word shingles 0.8 or more) stays."""
    return simhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: The classifier and the packing are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
