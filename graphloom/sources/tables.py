"""The property graph that lies in the star-schema tables.

Nodes: Region ``R<k>``, Nation ``N<k>``, Customer ``C<k>`` (also Party and its market segment), Supplier
``S<k>`` (also Party), Part ``P<k>`` (also its type), Order ``O<k>``, Event ``E<k>``.
Edges: IN_REGION, IN_NATION, PLACED, CONTAINS, SHIPPED_BY (one a line item), DID.
The foreign keys of these tables have no orphans, so a node join that asks nothing is left out.
"""

from __future__ import annotations

from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.graph import EdgeSource, Identity, NodeTable, PropertyGraph
from graphloom.sources.rownumbers import row_number

# The domains of the two columns that serve as labels.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

PREFIX = {"Region": "R", "Nation": "N", "Customer": "C", "Supplier": "S", "Part": "P", "Order": "O", "Event": "E"}
NUMBER = {name: i for i, name in enumerate(PREFIX)}


#: The columns of the tables that serve as properties, with their kinds.
_PROPS = {
    "region": {"name": ("r_name", "string")},
    "nation": {"name": ("n_name", "string")},
    "customer": {"name": ("c_name", "string"), "acctbal": ("c_acctbal", "double")},
    "supplier": {"name": ("s_name", "string"), "acctbal": ("s_acctbal", "double")},
    "part": {"name": ("p_name", "string"), "brand": ("p_brand", "string"), "size": ("p_size", "long"), "retailprice": ("p_retailprice", "double")},
    "orders": {"status": ("o_orderstatus", "string"), "totalprice": ("o_totalprice", "double"), "orderdate": ("o_orderdate", "datetime"), "priority": ("o_orderpriority", "string")},
    "events": {"ts": ("ts", "datetime"), "event_type": ("event_type", "string"), "value": ("value", "double")},
    "lineitem": {
        "linenumber": ("l_linenumber", "long"), "quantity": ("l_quantity", "double"), "extendedprice": ("l_extendedprice", "double"), "discount": ("l_discount", "double"),
        "tax": ("l_tax", "double"), "returnflag": ("l_returnflag", "string"), "linestatus": ("l_linestatus", "string"), "shipdate": ("l_shipdate", "datetime"),
    },
}
#: Node tables: kind, table, key column, further labels, label column with its domain.
_NODES = (
    ("Region", "region", "r_regionkey", (), None, ()),
    ("Nation", "nation", "n_nationkey", (), None, ()),
    ("Customer", "customer", "c_custkey", ("Party",), "c_mktsegment", SEGMENTS),
    ("Supplier", "supplier", "s_suppkey", ("Party",), None, ()),
    ("Part", "part", "p_partkey", (), "p_type", PART_TYPES),
    ("Order", "orders", "o_orderkey", (), None, ()),
    ("Event", "events", "event_id", (), None, ()),
)
#: Edge sources: type, table, source kind and key, target kind and key.
_EDGES = (
    ("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
    ("IN_NATION", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
    ("IN_NATION", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
    ("PLACED", "orders", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
    ("CONTAINS", "lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey")),
    ("SHIPPED_BY", "lineitem", ("Order", "l_orderkey"), ("Supplier", "l_suppkey")),
    ("DID", "events", ("Customer", "user_id"), ("Event", "event_id")),
)


@lru_cache(maxsize=8)
def _opened(application: str, spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return graph_from_tables(spark, sf_dir)


def opened_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables in a folder, opened once for an application and asked many times; the tables stay as they are."""
    return _opened(spark.sparkContext.applicationId, spark, sf_dir)


def graph_from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables in a folder; a table is opened when a query first touches it."""

    @lru_cache(maxsize=None)
    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    def props(table: str) -> dict[str, tuple[Column, str]]:
        return {prop: (F.col(column), kind) for prop, (column, kind) in _PROPS[table].items()}

    def identity(kind: str, column: str) -> Identity:
        return Identity(F.col(column), PREFIX[kind], NUMBER[kind])

    nodes = []
    for kind, table, key, labels, label_column, domain in _NODES:
        extra = {"purchase_value": (F.when(F.col("event_type") == "purchase", F.col("value")), "double")} if kind == "Event" else {}
        test = (lambda column: lambda label: F.col(column) == label)(label_column) if label_column else None
        nodes.append(NodeTable(kind, partial(read, table), identity(kind, key), frozenset({kind, *labels}), props(table) | extra, frozenset(domain), test))
    edges = [
        EdgeSource(
            f"{table}:{kind}", partial(read, table), partial(row_number, source=i), identity(*src), identity(*dst), frozenset({kind}),
            frozenset({src[0]}), frozenset({dst[0]}), None, props(table) if table == "lineitem" else {}, None,
            table != "lineitem",  # in the other tables one end is the key
        )
        for i, (kind, table, src, dst) in enumerate(_EDGES)
    ]
    return PropertyGraph(spark, nodes, edges)
