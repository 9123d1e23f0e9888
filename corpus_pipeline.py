"""A training-data pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
``documents``; what a stage rejects or cuts is gone for the next one. ``run`` writes every stage's rows as
Parquet into the shared folder and reads them back, so a lost executor costs its own tasks only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.llm import decontaminate, line_dedup, near_dup, packing, quality
from critica.llm.common import stored, table
from critica.session import apply_defaults

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines removed; documents that fail the rules, or lose over half of their words, rejected."""
    return quality.clean(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents removed; where they are over half of a document, their first occurrence stays."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", "lang", "source"), keep="text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more)."""
    return near_dup.keep_one(docs.select(*COLUMNS), width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.mark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(
        "not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document in sequences of at most 2048."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_dedup),
          ("decontaminate", decontaminated), ("best_fit_packing", packed)]
ORACLE_SQL = None  # packing is a search: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    apply_defaults(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
