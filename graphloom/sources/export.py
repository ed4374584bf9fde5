"""Node and edge rows to the text formats of other systems.

All writers are columns over the rows, so files are written by all tasks.  Dates in Cypher read month and
day 00 as 01; names that are no plain words stand in back quotes there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ordinal import DATE_TIME
from graphloom.sources.tsv import infer_kinds, typed

BATCH = 1000


def _entries(props: Column) -> Column:
    return F.array_sort(F.map_entries(props))


def _is_date(value: Column) -> Column:
    return value.rlike(DATE_TIME)


def _fixed_date(value: Column) -> Column:
    """Month and day 00 as 01."""
    return F.regexp_replace(F.regexp_replace(value, r"^([+-]?[0-9]+)-00-", "$1-01-"), r"^([+-]?[0-9]+-[0-9]{2})-00T", "$1-01T")


def _word(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit("`"), name, F.lit("`")))


def _cypher_value(value: Column) -> Column:
    return F.when(_is_date(value), F.concat(F.lit("datetime('"), _fixed_date(value), F.lit("')"))).otherwise(value)


def _cypher_props(props: Column) -> Column:
    return F.transform(_entries(props), lambda e: F.concat(_word(e["key"]), F.lit(": "), _cypher_value(e["value"])))


def nodes_to_cypher(nodes: DataFrame) -> DataFrame:
    """``CREATE (id:L1:L2 {qid: "id", key: value, ...});``, one node a row of ``value``."""
    labels = F.array_join(F.transform("labels", lambda x: F.concat(F.lit(":"), _word(x))), "")
    qid = F.array(F.concat(F.lit('qid: "'), F.col("id"), F.lit('"')))
    return nodes.select(F.concat(F.lit("CREATE ("), _word(F.col("id")), labels, F.lit(" {"), F.array_join(F.concat(qid, _cypher_props(F.col("props"))), ", "), F.lit("});")).alias("value"))


def edges_to_cypher(edges: DataFrame) -> DataFrame:
    props = F.when(F.size("props") > 0, F.concat(F.lit(" {"), F.array_join(_cypher_props(F.col("props")), ", "), F.lit("}"))).otherwise("")
    return edges.select(
        F.concat(F.lit('MATCH (a {qid: "'), "src", F.lit('"}), (b {qid: "'), "dst", F.lit('"}) CREATE (a)-[:'), _word(F.col("label")), props, F.lit("]->(b);")).alias("value")
    )


def _mql_props(props: Column) -> Column:
    def one(e: Column) -> Column:
        date = F.concat(F.lit('dateTimeStamp("'), F.regexp_replace(e["value"], r"^\+", ""), F.lit('")'))
        return F.concat(F.lit(" "), e["key"], F.lit(":"), F.when(_is_date(e["value"]), date).otherwise(e["value"]))

    return F.array_join(F.transform(_entries(props), one), "")


def nodes_to_mql(nodes: DataFrame) -> DataFrame:
    """``id :L1 :L2 key:value ...``, the graph text that goes with the MQL dialect."""
    labels = F.array_join(F.transform("labels", lambda x: F.concat(F.lit(" :"), x)), "")
    return nodes.select(F.concat("id", labels, _mql_props(F.col("props"))).alias("value"))


def edges_to_mql(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat("src", F.lit("->"), "dst", F.lit(" :"), "label", _mql_props(F.col("props"))).alias("value"))


_BULK = {"long": "long", "double": "double", "datetime": "datetime", "ordinal": "string", "string": "string"}


def _bulk_value(props: Column, key: str, kind: str) -> Column:
    value = F.element_at(props, key)
    if kind == "datetime":
        return F.regexp_replace(value, r"^\+", "")
    return typed(value, "string") if kind == "string" else value


def to_bulk_tables(nodes: DataFrame, edges: DataFrame, *, compact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tables for bulk import: ``id:ID, :LABEL, key:type...`` and ``:START_ID, :END_ID, :TYPE, key:type...``.

    ``compact`` keeps one JSON column ``properties`` in place of the string columns.  Write with :func:`write_table`.
    """

    def columns(df: DataFrame) -> list[Column]:
        kinds = infer_kinds(df)
        wide = [_bulk_value(F.col("props"), k, kind).alias(f"{k}:{_BULK[kind]}") for k, kind in kinds.items() if not compact or kind in ("long", "double", "datetime")]
        if compact:
            text = [k for k, kind in kinds.items() if kind in ("string", "ordinal")]
            wide.append(F.to_json(F.map_filter("props", lambda k, v: k.isin(text) if text else F.lit(False))).alias("properties:string"))
        return wide

    node_table = nodes.select(F.col("id").alias("id:ID"), F.array_join(F.concat(F.array(F.lit("Entity")), "labels"), ";").alias(":LABEL"), *columns(nodes))
    edge_table = edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("label").alias(":TYPE"), *columns(edges))
    return node_table, edge_table


def to_unwind_batches(edges: DataFrame, size: int = BATCH) -> DataFrame:
    """Cypher ``UNWIND [...] AS row`` statements, each of at most ``size`` edges of one type.

    Edges are numbered within their task, so no task gathers the edges of a frequent type.
    """
    numbered = edges.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    row = F.concat(F.lit('{a: "'), "src", F.lit('", b: "'), "dst", F.lit('", p: {'), F.array_join(_cypher_props(F.col("props")), ", "), F.lit("}}"))
    numbered = numbered.withColumn("__batch", F.floor(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) / size))
    batches = numbered.groupBy("__part", "__batch", "label").agg(F.array_join(F.collect_list(row), ", ").alias("rows"))
    return batches.select(F.concat(F.lit("UNWIND ["), "rows", F.lit("] AS row MATCH (a:Entity {qid: row.a}), (b:Entity {qid: row.b}) CREATE (a)-[e:"), _word(F.col("label")), F.lit("]->(b) SET e += row.p;")).alias("value"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)
