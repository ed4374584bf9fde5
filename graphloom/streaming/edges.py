"""Edge lines that keep arriving: a stream of native TSV files, loaded with the rules of the batch loader.

Each micro-batch is written to a folder of its own number, replacing what an earlier attempt at the same batch left, so
a retried batch adds no edge twice.  Edges whose ends are not declared yet may wait in a folder of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.tsv import parse_edge_lines, with_known_ends

_ROWS = "src string, dst string, props map<string,string>, label string, batch long"


def stream_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edge rows of the text files that appear in a folder; no state is kept."""
    return parse_edge_lines(spark.readStream.text(folder))


def write_batch(batch: DataFrame, number: int, nodes: DataFrame, target: str, waiting: str | None = None) -> None:
    """One micro-batch: edges with declared ends by type, the others to ``waiting`` if it is given."""
    batch = batch.persist()
    try:
        ids = nodes.select("id").distinct()
        with_known_ends(ids, batch).write.mode("overwrite").partitionBy("label").parquet(f"{target}/batch={number}")
        if waiting:
            known = ids.withColumn("there", ids["id"].isNotNull())
            ends = batch.join(known.toDF("src", "__s"), "src", "left").join(known.toDF("dst", "__d"), "dst", "left")
            ends.filter("__s IS NULL OR __d IS NULL").select(*batch.columns).write.mode("overwrite").partitionBy("label").parquet(f"{waiting}/batch={number}")
    finally:
        batch.unpersist()


def append_known_edges(spark: SparkSession, folder: str, nodes: DataFrame, target: str, checkpoint: str, waiting: str | None = None) -> StreamingQuery:
    """Append arriving edges with declared ends to Parquet, by batch and type.

    Each micro-batch is joined with the nodes as they are then; other edges are dropped as in a batch load, or
    wait in the folder ``waiting``.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, nodes, target, waiting)

    return stream_edges(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edges(spark: SparkSession, target: str, waiting: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The edges that have arrived, with those that waited and whose ends are declared by now."""
    edges = spark.read.schema(_ROWS).parquet(target).select("src", "label", "dst", "props")
    if waiting is None:
        return edges
    late = spark.read.schema(_ROWS).parquet(waiting).select("src", "label", "dst", "props")
    return edges.unionByName(with_known_ends(nodes.select("id").distinct(), late))
