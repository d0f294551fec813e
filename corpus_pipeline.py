"""A training corpus out of ``documents``: bad text goes, then repeated lines, near-copies and benchmark passages; what stays is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. ``run`` frees what
a stage's operators wrote between their own steps, and the table before, as soon as its output is written, and logs how many rows stay.

Cases: a document with a null or empty text passes every stage but the first, which judges it like any other text; a null doc_id takes no
part in line dedup and near-dedup and is judged by its own row elsewhere; of repeated rows of one doc_id one stays after near-dedup; texts of any length
are worked on whole; an empty table gives an empty one; without labels every document is kept by the first stage, without benchmark items by
the fourth. Other columns are kept until the last stage.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import bpe, decontaminate, linededup, minhash, quality
from talus.session import Workspace, scratch

LOG = logging.getLogger(__name__)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more), unchanged."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or line has; documents that lose every line go, others keep their columns (n_chars follows the text)."""
    kept = linededup.dedup_lines(docs).where("n_removed = 0 OR length(text) > 0")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity of 0.8 or more)."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    return bpe.encode(docs)


STAGES = [("quality", good_quality), ("lines", line_dedup), ("near_copies", near_dedup), ("benchmark", no_benchmark), ("tokens", tokenised)]
#: SQL can't express the classifier or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs, last = Workspace(spark, "corpus"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = ws.put(name, stage(spark, docs, sf_dir))
        if last:
            ws.drop(last)
        last = name
        LOG.info("%s: %d documents stay", name, docs.count())
    return STAGES[-1][1](spark, docs, sf_dir)
