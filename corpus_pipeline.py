"""A training corpus in four stages: language identification, near-duplicate removal, mixing, packing.

Each stage takes the documents that its predecessor kept and is written as Parquet before the next one reads it.
All but the last return the columns of documents. The tables that a stage keeps in the shared folder are deleted when the next one begins, as its result is
written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sortweave.llm import curriculum, hilbert_pack, language_id, near_copies
from sortweave.llm.common import keep, recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_kept: dict[str, list[str]] = {}


def after(before: str) -> Callable[[Stage], Stage]:
    """A stage that begins by deleting what the stage ``before`` kept."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, _kept.pop(before, []))
            with recorded() as paths:
                out = stage(spark, docs, sf_dir)
            _kept.setdefault(stage.__name__, []).extend(paths)
            return out

        return run

    return wrap


@after("")
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; rejected ones go."""
    return language_id.keep_identified(docs)


@after("language")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: found by SimHash anchors and rare shingles, decided by a Jaccard similarity of five-word shingles of at least 0.8."""
    return near_copies.dedupe(docs)


@after("near_duplicates")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return curriculum.mix(docs)


@after("mix")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return hilbert_pack.pack(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("source_mix", mix), ("pack", pack)]

#: SQL can express neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs, name)
    return docs
