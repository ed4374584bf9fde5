"""Stored graphs: Parquet tables with ranks for ids, partitioned by edge type, and a small catalog.

``node_id`` is the rank of the id in byte order, ``edge_id`` the rank of the edge by (type, target, source,
properties), both from 1.  Parallel edges get ranks of their own.  Queries that name an edge type read
only that type's partition.  The properties of up to ``MOST_COLUMNS`` keys a table stand in columns of their
kind, so conditions on them reach the Parquet reader; those of all further keys stay in the map of texts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ranks import dense_ranks
from graphloom.plans.graph import EdgeSource, Identity, NodeTable, PropertyGraph
from graphloom.sources.tsv import infer_kinds, merged_nodes, names_of, typed, with_known_ends

MOST_COLUMNS = 500
_SPARK = {"long": "long", "double": "double", "datetime": "timestamp_ntz", "ordinal": "long", "string": "string"}


def _with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with a typed column ``p0``, ``p1``, ... for each of the first keys, which leave the map."""
    keys = list(kinds)[:MOST_COLUMNS]
    if not keys:
        return df
    rest = F.map_filter("props", lambda k, v: ~k.isin(keys)) if len(kinds) > len(keys) else F.create_map().cast("map<string,string>")
    return df.withColumns({**{f"p{i}": typed(F.element_at("props", k), kinds[k]).cast(_SPARK[kinds[k]]) for i, k in enumerate(keys)}, "props": rest})


def _props(kinds: dict[str, str]) -> dict:
    return {k: (F.col(f"p{i}") if i < MOST_COLUMNS else typed(F.element_at("props", k), kind), kind) for i, (k, kind) in enumerate(kinds.items())}


def _schema(columns: str, kinds: dict[str, str]) -> str:
    return columns + "".join(f", p{i} {_SPARK[kind]}" for i, kind in enumerate(list(kinds.values())[:MOST_COLUMNS]))


def _squares(links: DataFrame) -> dict[str, dict[str, float]]:
    """How unevenly edges of a type lie on nodes: over all nodes the sums of out x out, in x in and out x in, one row a type."""
    ends = links.select("label", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1.0).alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.lit(1.0).alias("i")))).alias("e"))
    degrees = ends.groupBy("label", "e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    sums = degrees.groupBy("label").agg(*[F.sum(F.col(a) * F.col(b)).alias(name) for name, a, b in (("src", "o", "o"), ("dst", "i", "i"), ("both", "o", "i"))])
    out: dict[str, dict[str, float]] = {"src": {}, "dst": {}, "both": {}}
    for row in sums.collect():
        for name in out:
            out[name][row["label"]] = row[name]
    return out


_NODES, _EDGES = "id string, labels array<string>, props map<string,string>, node_id long", "src string, dst string, props map<string,string>, edge_id long, label string"


def build(nodes: DataFrame, edges: DataFrame, path: str) -> dict:
    """Write the tables and return their catalog."""
    spark = nodes.sparkSession
    stored = dense_ranks(merged_nodes(nodes), ["id"], "node_id")
    node_props = infer_kinds(stored)
    _with_columns(stored, node_props).write.mode("overwrite").parquet(f"{path}/nodes")
    stored = spark.read.schema(_NODES).parquet(f"{path}/nodes")
    kept = with_known_ends(stored, edges.select("src", "label", "dst", "props"))
    keyed = kept.withColumn("__props", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props"))))).withColumn("__row", F.monotonically_increasing_id())
    ranked = dense_ranks(keyed, ["label", "dst", "src", "__props", "__row"], "edge_id").drop("__props", "__row")
    edge_props = infer_kinds(ranked)
    _with_columns(ranked, edge_props).write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")
    links = spark.read.schema(_EDGES).parquet(f"{path}/edges")
    catalog = {
        "nodes": stored.count(),
        "labels": sorted(names_of(stored, F.explode("labels"))),
        "types": names_of(links, F.col("label")),
        "squares": _squares(links),
        "node_props": node_props,
        "edge_props": edge_props,
    }
    spark.createDataFrame([(json.dumps(catalog, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")
    return catalog


def load(spark: SparkSession, path: str) -> PropertyGraph:
    """A stored graph; only its catalog is read now."""
    catalog = json.loads(spark.read.text(f"{path}/catalog").head()[0])
    node_props, edge_props = catalog["node_props"], catalog["edge_props"]
    nodes = spark.read.schema(_schema(_NODES, node_props)).parquet(f"{path}/nodes")
    edges = spark.read.schema(_schema(_EDGES, edge_props)).parquet(f"{path}/edges")
    table = NodeTable("Node", lambda: nodes, Identity(F.col("id")), frozenset(), _props(node_props), frozenset(catalog["labels"]), lambda label: F.array_contains("labels", label), F.col("node_id"), float(catalog["nodes"]))
    every = frozenset({"Node"})
    types = frozenset(catalog["types"])
    source = EdgeSource("Edge", lambda: edges, lambda df: F.col("edge_id"), Identity(F.col("src")), Identity(F.col("dst")), types, every, every, F.col("label"), _props(edge_props), {k: float(v) for k, v in catalog["types"].items()}, squares=catalog.get("squares"))
    return PropertyGraph(spark, [table], [source])
