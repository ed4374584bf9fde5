"""The native text format: two files of tab-separated lines, and graphs made of its rows.

    <prefix>-nodes.tsv   id \\t :L1:L2 \\t key:value \\t ...
    <prefix>-edges.tsv   from \\t TYPE \\t to \\t key:value \\t ...

Rows in frames: nodes ``(id, labels ARRAY, props MAP)``, edges ``(src, label, dst, props MAP)``, where
properties keep the text they are written in (``42``, ``3.14``, ``+1964-09-02T00:00:00Z``, ``"quoted"``).

Rules: fields are trimmed, empty labels and properties without a key are skipped, the first ``:`` ends a
key, of a repeated key the last value counts.  A node may be declared more than once: its labels and
properties add up.  Edges with an undeclared end are dropped on loading; parallel edges stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ordinal import DATE_TIME, ordinal_of_text
from graphloom.plans.graph import EdgeSource, Identity, NodeTable, PropertyGraph

MOST_NAMES = 100_000
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _pairs(fields: Column) -> Column:
    """Map of ``key:value`` texts; the last value of a key counts."""
    entries = F.filter(F.transform(fields, lambda x: F.split(F.trim(x), ":", 2)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    pairs = F.transform(entries, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def split_properties(text: Column) -> Column:
    """Map of a tab-separated list of ``key:value``; empty for null."""
    return _pairs(F.split(F.coalesce(text, F.lit("")), "\t"))


def parse_node_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    field = F.split(F.col(line), "\t")
    labels = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(field, F.lit(2)), F.lit("")), ":"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.slice(field, 3, F.greatest(F.size(field) - 2, F.lit(0)))
    return lines.select(F.trim(field[0]).alias("id"), labels.alias("labels"), _pairs(rest).alias("props")).filter("id != ''")


def parse_edge_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    field = F.split(F.col(line), "\t")
    part = lambda i: F.trim(F.try_element_at(field, F.lit(i)))
    rest = F.slice(field, 4, F.greatest(F.size(field) - 3, F.lit(0)))
    return lines.select(part(1).alias("src"), part(2).alias("label"), part(3).alias("dst"), _pairs(rest).alias("props")).filter("src != '' AND label != '' AND dst != ''")


def read_tsv(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of ``<prefix>-nodes.tsv`` and ``<prefix>-edges.tsv``."""
    return parse_node_lines(spark.read.text(f"{prefix}-nodes.tsv")), parse_edge_lines(spark.read.text(f"{prefix}-edges.tsv"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id.  Labels and properties are combined before ids are gathered, so an id that is declared very often stays small."""
    labels = nodes.select("id", F.explode("labels").alias("label")).distinct().groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    ids = nodes.select("id").distinct()
    out = ids.join(labels, "id", "left")
    cells = nodes.withColumn("__at", F.monotonically_increasing_id()).select("id", "__at", F.explode("props").alias("k", "v"))
    cells = cells.groupBy("id", "k").agg(F.max(F.struct("__at", "v")).alias("last"))
    props = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "last.v"))).alias("props"))
    out = out.join(props, "id", "left")
    return out.select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def with_known_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are declared nodes."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def clean(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose target is declared (the source is not looked at), and the nodes that such an edge uses."""
    kept = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    used = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(used, "id", "left_semi"), kept


def infer_kinds(props: DataFrame) -> dict[str, str]:
    """The kind of each key of a column ``props``: all integers, all numbers, all dates, or strings.

    Dates that no timestamp holds (month or day 00, years before 1) make the key an ordinal.
    One row a key goes through the driver; more than ``MOST_NAMES`` keys are refused.
    """
    v = F.col("v")
    cells = props.select(F.explode("props").alias("k", "v"))
    date, time = v.rlike(DATE_TIME), F.regexp_replace(v, r"^\+|Z$", "").try_cast("timestamp_ntz")
    kinds = cells.groupBy("k").agg(
        F.min(v.rlike(INTEGER) & v.try_cast("long").isNotNull()).alias("long"), F.min(v.rlike(NUMBER)).alias("double"), F.min(date).alias("date"), F.min(date & time.isNotNull() & ~v.rlike("^-|^[+]?0000")).alias("time")
    )
    rows = kinds.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} property keys")
    return {r["k"]: "long" if r["long"] else "double" if r["double"] else "datetime" if r["time"] else "ordinal" if r["date"] else "string" for r in sorted(rows, key=lambda r: r["k"])}


def typed(value: Column, kind: str) -> Column:
    """A property text in its kind; text that does not fit is null."""
    if kind == "long":
        return value.try_cast("long")
    if kind == "double":
        return value.try_cast("double")
    if kind == "datetime":
        return F.regexp_replace(value, r"^\+|Z$", "").try_cast("timestamp_ntz")
    if kind == "ordinal":
        return ordinal_of_text(value)
    return F.regexp_replace(value, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")


def names_of(df: DataFrame, column: Column) -> dict[str, int]:
    """How often each name occurs; more than ``MOST_NAMES`` names are refused."""
    rows = df.select(column.alias("x")).filter("x IS NOT NULL").groupBy("x").count().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return {r[0]: r[1] for r in rows}


def graph_from_frames(nodes: DataFrame, edges: DataFrame, node_props: Mapping[str, str] | None = None, edge_props: Mapping[str, str] | None = None, *, merge: bool = True) -> PropertyGraph:
    """A graph of node and edge rows.  Kinds of properties are inferred where not given.

    Edges without an ``edge_id`` are numbered as they come; :mod:`graphloom.sources.store` gives them stable ranks.
    """
    nodes = merged_nodes(nodes) if merge else nodes
    edges = with_known_ends(nodes, edges)
    if "edge_id" not in edges.columns:
        edges = edges.withColumn("edge_id", F.monotonically_increasing_id() + 1)
    node_props = infer_kinds(nodes) if node_props is None else node_props
    edge_props = infer_kinds(edges) if edge_props is None else edge_props
    labels, types = frozenset(names_of(nodes, F.explode("labels"))), frozenset(names_of(edges, F.col("label")))
    prop = lambda kinds: {k: (typed(F.element_at("props", k), kind), kind) for k, kind in kinds.items()}
    rank = F.col("node_id") if "node_id" in nodes.columns else None
    table = NodeTable("Node", lambda: nodes, Identity(F.col("id")), frozenset(), prop(node_props), labels, lambda label: F.array_contains("labels", label), rank)
    every = frozenset({"Node"})
    source = EdgeSource("Edge", lambda: edges, lambda df: F.col("edge_id"), Identity(F.col("src")), Identity(F.col("dst")), types, every, every, F.col("label"), prop(edge_props))
    return PropertyGraph(nodes.sparkSession, [table], [source])


def load_tsv(spark: SparkSession, prefix: str) -> PropertyGraph:
    return graph_from_frames(*read_tsv(spark, prefix))


def _prop_texts(props: Column) -> Column:
    """Key and value texts in the order of keys."""
    return F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))


def write_tsv(nodes: DataFrame, edges: DataFrame, prefix: str) -> None:
    """Folders ``<prefix>-nodes.tsv`` and ``<prefix>-edges.tsv`` of text files, which :func:`read_tsv` reads."""
    label = F.when(F.size("labels") > 0, F.concat(F.lit(":"), F.array_join("labels", ":"))).otherwise("")
    node = F.array_join(F.concat(F.array("id", label), _prop_texts(F.col("props"))), "\t")
    edge = F.array_join(F.concat(F.array("src", "label", "dst"), _prop_texts(F.col("props"))), "\t")
    nodes.select(node.alias("value")).write.mode("overwrite").text(f"{prefix}-nodes.tsv")
    edges.select(edge.alias("value")).write.mode("overwrite").text(f"{prefix}-edges.tsv")
