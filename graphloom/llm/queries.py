"""Queries of the language-model problems, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks, looks, mixing
from graphloom.session import cut_lineage


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.leaked_windows(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per document and item: how many of the item's windows leaked, and where the leak starts in either."""
    found = leaks.leaked_windows(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))
    return found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.countDistinct("item_at").alias("n_windows"), F.min("item_at").alias("first_item_word"), F.min("doc_at").alias("first_doc_word")
    )


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[1]


def p8_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the mix fills the quota of each source that has a target and documents, as far as whole documents can."""
    report = mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[1]
    return report.filter("quota_tokens > 0").select("source", "filled")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    prints = cut_lineage(looks.fingerprints(_table(spark, sf, "documents"), "doc_id", "text"))  # the texts are read once
    return looks.same_look_pairs(prints, "doc_id")


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that has a text, with the smallest id that looks the same and the exact number of different texts.

    Null and empty texts have no look: as in ``p9_found`` they take no part and get no row.
    """
    prints = cut_lineage(looks.fingerprints(_table(spark, sf, "documents"), "doc_id", "text"))
    return looks.look_classes(prints, "doc_id")


QUERIES = {f.__name__: f for f in (p7_found, p7_report, p8_mix, p8_shares, p8_quotas, p9_found, p9_classes)}
ORACLE: dict[str, str] = {
    "p8_quotas": """
        SELECT DISTINCT lower(trim(t.source)) AS source, true AS filled FROM mix_targets t JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source))
        WHERE d.text <> '' AND t.target_share > 0 AND t.max_repeats > 0""",
}
