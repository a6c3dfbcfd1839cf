"""A training corpus from raw documents: toxicity, language, exact copies, near copies, packing.

run() applies the stages in order. Each stage reads all that the one before it kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from leadframe.llm import exact_dedup, langid, ngram_join, packing, toxicity
from leadframe.llm.common import fresh_path, removed, run_folder, stored

#: The languages to keep; None: all that the labels of the documents name.
LANGUAGES: tuple[str, ...] | None = None
#: A document is kept if its language is one of them and the model is at least so sure of it, against the others and against none of them.
LEAST_SURE = 0.5

#: What this job hands to Python workers at once, if its session would hand over more: rows, and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def settled(spark: SparkSession) -> None:
    """The job's settings for its session. Operators set none; a stage is run when its rows are written, so these must hold until then."""
    for name, most in BATCH.items():
        now = int(re.sub(r"\D*$", "", spark.conf.get(name)))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage whose intermediate tables share a folder. As a stage's rows are written before the next stage begins, that one removes the folder."""
    @wraps(stage)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settled(spark)
        while _left:
            removed(spark, _left.pop())
        with run_folder(spark, stage.__name__, keep=True) as path:
            _left.append(path)
            return stage(spark, docs, sf_dir)

    return own


@tidy
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on all labels, does not predict to be toxic.

    Null and empty texts score the model's bias; each of repeated rows is judged alike; an empty table gives an empty result;
    columns that docs has besides pass through, here as in the other stages.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


@tidy
def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language to keep. Null texts, texts without a letter and texts that are in no language the model has learned go.

    Documents that mix known languages stay. Each of repeated rows is judged alike; an empty table gives an empty result.
    """
    return langid.in_known_language(docs, langid.train(docs), LEAST_SURE, LANGUAGES)


@tidy
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, rows with null and repeated ids included. Null and empty texts are one group; an empty table gives an empty result."""
    return exact_dedup.one_of_each(docs)


@tidy
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group linked by a Jaccard of 0.8 or more of five-word shingles.

    Rows with null and repeated ids are linked by their texts like any others; null texts and texts without a word stay; an
    empty table gives an empty result.
    """
    return ngram_join.one_of_each(docs, size=5, num=8, den=10)


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens. Null and empty texts are one token, repeated rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("language_id", in_known_language), ("exact_dedup", without_copies), ("ngram_jaccard_join", without_near_copies), ("packing", packed)]

#: SQL can't express the learned stages and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            removed(spark, before)  # only the last stage's rows are read again
        before = path
    return docs
