"""A training corpus in stages, each applying one of the corpus operators to all that its predecessor kept.

All stages but the last return the columns of `documents`; the last adds the copies that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutwise.llm import decontaminate, language, lines, mixing, simhash
from boutwise.llm.common import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected, and writes the language found into lang."""
    learned = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.predict_language(docs, learned, keep=docs.columns)
    return found.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that three documents or more hold, but for the largest doc_id; documents left empty by it go."""
    kept = lines.dedup_lines(docs, keep=docs.columns)
    emptied = (F.col("n_dropped") > 0) & (F.length("kept") == 0)
    return kept.filter(~emptied).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how often it takes each; rows that share a doc_id share their copies, rounded up."""
    mix = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.ceil(F.sum("copies") / F.count("*")).alias("copies")).filter("copies > 0")
    return docs.drop("copies").join(mix, F.col("doc_id").eqNullSafe(F.col("mixed_id"))).drop("mixed_id")


STAGES = [
    ("language", language_stage), ("lines", line_stage), ("near copies", near_copies_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
