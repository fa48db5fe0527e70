"""A corpus pipeline: quality, line chunks, near duplicates, benchmark text, mixture.

Each stage takes the session, the documents that the stage before kept, and the folder of the tables.  All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from campusflow.llm.stored import shared_folder


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` again after a text has been cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject."""
    return quality_rules.score_quality(docs).filter("kept").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines, grown to the edges of their runs, that an earlier one has.

    A document of nothing else goes.
    """
    cut = line_dedup.remove_repeated_runs(docs)
    left = cut.filter((F.col("n_removed_chunks") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return _sized(left.select(*docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return jaccard_join.one_per_component(docs, n=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _sized(decontamination.remove_contamination(docs, items))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, share: float | None = None) -> DataFrame:
    """The documents sampled towards the target mixture, with topic, tokens and probability.

    ``share`` is the part of the tokens to keep; without it the rarest cell decides, see ``mixing.mix_sources``.
    """
    mixed = mixing.mix_sources(docs, share=share).filter("sampled").drop("sampled")
    return mixed.withColumn("probability", F.round("probability", 9))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("line dedup", cut_repeated_lines),
    ("near duplicates", keep_one_of_near),
    ("benchmark decontamination", cut_benchmark),
    ("mixture", sample_mixture),
]

# Line chunks, their runs and components have no SQL form; tests/llm hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, share: float | None = None) -> DataFrame:
    """All stages over the table of documents; each but the last is written as Parquet and read again.

    ``share`` is the part of the tokens before the last stage that the mixture keeps.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return sample_mixture(spark, docs, sf_dir, share)
