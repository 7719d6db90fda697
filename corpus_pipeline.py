"""A corpus pipeline over the table documents: each stage calls one operator and works on all that the stage before it kept.

Rows are known by doc_id and text, so null or shared ids change no decision; null and empty texts pass all stages but the last, which takes no copies
of what has no words; empty tables give empty results; columns other than COLUMNS are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoframe.llm import decontaminate, jaccard, lines, mixing, quality
from ethoframe.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, quality.fit(docs, labels)).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; one that loses its last line goes, one that had none stays."""
    kept = lines.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that with the smallest doc_id; of rows that repeat each other one stays. Rows without words stay."""
    return jaccard.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of the benchmark, each judged by its own text, with or without a doc_id."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that the mix takes; those it doesn't take go."""
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
]

#: SQL expresses neither the classifier nor the fuzzy classes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
