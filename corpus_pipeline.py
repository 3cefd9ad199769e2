"""The corpus pipeline: five of the training-data operators, one after the other, each over all that its predecessor kept.

Defined cases: every stage works on rows, not on ids, so rows whose doc_id is null or repeated are judged, deduplicated and cut like any other; a
null text counts as empty and stays null; of equal rows the near-duplicate stage leaves one; an empty table passes all stages; columns of any
other name and type come through unchanged, but n_chars, where it is a whole number, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, packing, quality, simhash, substring
from vigil.llm.common import written
from vigil.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents stay."""
    return substring.remove(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from the texts; documents stay."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_stage), ("near_duplicates", near_duplicate_stage), ("substring_dedup", substring_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The fingerprints' hash and the tokenizer can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
