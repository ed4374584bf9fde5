"""Pairs of rows that belong together though their texts differ.

Pairs are made between the distinct texts of a group first; rows come in only then, so a text with very many
copies costs no comparison of copies with each other.  Texts of a large group and rows of such a text are salted.

Defined results: rows with a null group column, text or key are in no pair; repeated rows of one text are in
no pair with each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def differing_pairs(df: DataFrame, group: Sequence[str], text: str, key: str, *, salts: int = SALTS) -> DataFrame:
    """``(<key>_a, <key>_b)``, the smaller key first, of rows that agree in ``group`` and differ in ``text``."""
    places = [f"g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(group, places)], F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")).dropna()
    distinct = rows.groupBy(*places, "text").agg(F.count(F.lit(1)).alias("n")).drop("n")
    several = distinct.groupBy(*places).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    distinct = distinct.join(several, places, "left_semi")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    # only groups of several texts are left; one side is salted, the other repeated
    one = distinct.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int")).withColumnRenamed("text", "text_a")
    pairs = one.join(distinct.withColumn("salt", salt).withColumnRenamed("text", "text_b"), [*places, "salt"]).filter("text_a < text_b").drop("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    left = pairs.withColumn("salt", salt).join(salted.withColumnsRenamed({"text": "text_a", "key": "a"}), [*places, "text_a", "salt"]).select(*places, "text_b", "a")
    both = left.withColumn("salt", salt).join(salted.withColumnsRenamed({"text": "text_b", "key": "b"}), [*places, "text_b", "salt"])
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
