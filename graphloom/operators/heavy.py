"""Per-key results without imbalance when a few keys hold most rows.

Multi-level tree aggregation.  Leaves: every task combines the rows of its input split (a chunk of the fixed size
``spark.sql.files.maxPartitionBytes``) by key and target before anything is sent.  The combined rows are sent
by key *and* target, so a hot key is spread over all tasks, its distinct targets are found exactly, and
targets of different tasks are disjoint, so distinct counts add up.  Each of those tasks then makes one
state of each of its keys, and the states are merged in rounds: a round brings together the states of ``fan_in``
neighbouring tasks, and there are as many rounds as the number of tasks needs.  No reducer of a round ever receives
more than ``fan_in`` states of a key, however many rows, targets or partial states the key has.

Defined results
* null keys are a group of their own (``key_value`` null); null targets count as rows only.
* first and last are null where no row of the key has a time.
* repeated rows count each time, but not as further distinct targets.
* an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


def tree_aggregate(df: DataFrame, fields: Sequence[str], target: str, at: str, *, fan_in: int = FAN_IN) -> DataFrame:
    """``(field, key_value, n_rows, n_targets, first_at, last_at)`` for every value of every field."""
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    keys = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("key_value")) for f in fields])
    rows = df.select(F.explode(keys).alias("k"), F.col(f"`{target}`").alias("target"), F.col(f"`{at}`").alias("at"))
    level = (
        rows.groupBy("k.field", "k.key_value", "target")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        .withColumn("n_targets", F.col("target").isNotNull().cast("long"))
        .withColumn("node", F.spark_partition_id())  # the task that holds the row: one state of a key each
        .drop("target")
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = [F.sum("n_rows").alias("n_rows"), F.sum("n_targets").alias("n_targets"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        level = level.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("field", "key_value", "node").agg(*merged)
    return level.groupBy("field", "key_value").agg(*merged)


def heavy_keys(df: DataFrame, fields: Sequence[str], target: str, at: str, *, percent: int = 2, total: int | None = None) -> DataFrame:
    """Rows of :func:`tree_aggregate` whose non-null key holds at least ``percent`` % of all rows.

    ``total`` is the number of all rows; by default it is counted, which for Parquet reads footers only.
    """
    total = df.count() if total is None else total
    return tree_aggregate(df, fields, target, at).filter(F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= F.lit(percent * total)))
