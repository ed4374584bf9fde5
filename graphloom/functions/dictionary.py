"""Dictionaries of names: each distinct name and its rank in byte order, counted from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranks import dense_ranks


def build(names: DataFrame, column: str) -> DataFrame:
    """``(id, node_id)`` of the distinct non-null values of a column."""
    distinct = names.select(F.col(f"`{column}`").cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return dense_ranks(distinct, ["id"], "node_id")


def locate(dictionary: DataFrame, name: str) -> DataFrame:
    """The entry of a name; no row if there is none."""
    return dictionary.filter(F.col("id") == name)


def extract(dictionary: DataFrame, number: int) -> DataFrame:
    return dictionary.filter(F.col("node_id") == number)


def with_prefix(dictionary: DataFrame, prefix: str) -> DataFrame:
    return dictionary.filter(F.col("id").startswith(prefix))


def with_substring(dictionary: DataFrame, part: str) -> DataFrame:
    return dictionary.filter(F.col("id").contains(part))


def between_ranks(dictionary: DataFrame, first: int, last: int) -> DataFrame:
    """Entries of the ranks from ``first`` to ``last``, both included."""
    return dictionary.filter(F.col("node_id").between(first, last))


def entries(dictionary: DataFrame) -> DataFrame:
    """All entries in the order of their names."""
    return dictionary.orderBy("id")


def contains(dictionary: DataFrame, name: str) -> bool:
    return bool(locate(dictionary, name).limit(1).count())


def size(dictionary: DataFrame) -> int:
    return dictionary.count()
