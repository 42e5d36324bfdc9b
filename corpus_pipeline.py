"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import host_quality, language, near_copies, packing, pii
from quireline.llm.scratch import cut, drop, recorded, spread

#: Documents of a lower pooled language probability go; an even guess over four languages has 0.25.
MIN_LANGUAGE_SCORE = 0.3

#: SQL can express neither the trained language model nor minwise keys and BPE ids; tests hold run() against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and those of their host.

    Null, empty and very short texts go; repeated rows stay or go together; an empty table stays one.
    """
    return host_quality.host_quality(docs, docs.columns).where("kept").select("doc.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network tells; without any labelled document nothing can be told and all stay.

    Texts that are null or without a letter go; repeated rows stay or go together; an empty table stays one.
    """
    model = language.train(docs)
    if not model.names:
        return docs
    told = language.identify(docs, model, docs.columns)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles and a similarity of 0.8 or more.

    Null, empty and blank texts are copies of each other; of repeated rows one stays; null ids are the last to stay.
    """
    return near_copies.near_copies_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; every row stays, null and empty texts as they are."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of tokens; a null or empty text is its end id alone, an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


class Pipeline:
    """One run of the stages, which owns the tables that they cut for themselves.

    A stage's tables are read until its result has been written, which it has once the next stage is called:
    then they are deleted. What the last stage has cut stays until the driver ends, or ``close``.
    """

    def __init__(self) -> None:
        self.made: list[str] = []

    def staged(self, function: Stage) -> Stage:
        """A stage that first deletes what the one before it has cut."""

        @functools.wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            self.close(spark)
            with recorded() as made:
                out = function(spark, docs, sf_dir)
            self.made = made
            return out

        return run_stage

    def close(self, spark: SparkSession) -> None:
        """Delete the last stage's own tables; its result must have been written, or be wanted no more."""
        drop(spark, self.made)
        self.made = []

    def stages(self) -> list[tuple[str, Stage]]:
        functions = (("quality", quality), ("language", known_language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed))
        return [(name, self.staged(function)) for name, function in functions]


#: The stages for a caller that runs them one after the other and writes each result; ``run`` has its own.
STAGES = Pipeline().stages()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stages = Pipeline().stages()
    for name, apply in stages[:-1]:
        docs = cut(apply(spark, docs, sf_dir), name)
    return stages[-1][1](spark, docs, sf_dir)
