"""Queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import decontaminate, filter_audit, licenses, near_dedup, packing, pii, quality_pu, quality_rules, sort_means, toxicity, url_rules, vector_dedup, warc
from skytally.llm.common import fold_of, table


def _scored(df: DataFrame, folds: int, held: int, cutoff: float) -> DataFrame:
    own = fold_of(F.col("doc_id"), folds) == held
    return df.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = quality_pu.fitted(docs, table(spark, sf_dir, "labels"))
    return _scored(quality_pu.score(docs.select("doc_id", "text"), made and made[0]).drop("text"), 4, 2, 0.7)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs.select("doc_id", "text"), net).drop("text"), 5, 0, 0.5)


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    captures = warc.assemble(warc.read_archives(spark, path))
    return warc.page_report(captures)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_quality_pu, op2_toxicity, op3_semi_markov_pii, op4_decontaminate, op5_warc_transactions,
        op6_vector_packing, op7_quality_rules, op8_url_rules, op9_minhash_near_dedup, op10_license_sentences,
        op11_filter_audit, op12_vector_dedup, op13_sort_means,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_transactions": warc.ORACLE_SQL,
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op8_url_rules": url_rules.ORACLE_SQL,
        "op10_license_sentences": licenses.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_vector_dedup": vector_dedup.ORACLE_SQL,
        "op13_sort_means": sort_means.ORACLE_SQL,
    }
