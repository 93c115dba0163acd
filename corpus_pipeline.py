"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import decontaminate, near_dedup, packing, pii, toxicity
from skytally.llm.common import free_name, materialise, table

#: A document is rejected as toxic from this score on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose every window scores under ``TOXIC``; training reads the labelled documents of ``sf_dir``.

    Null, empty and blank texts score 0 and stay, as do null ids; repeated rows stay or go together; columns keep their names.
    """
    net = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name("toxicity_score", docs)
    return toxicity.score(docs, net, into=name).where(F.col(name) < TOXIC).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Null and empty texts and null ids stay. Of rows that share an id and stand for others' text, all stay or go together.
    """
    return near_dedup.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts and null ids stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets and n_chars brought up to date; no document is dropped, nulls stay."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens; null and empty texts are their end token alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("packing", pack),
]

#: Networks, edit distances and tokenizers can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
