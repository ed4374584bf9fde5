"""Queries over import, export, stored graphs and run control, each with the SQL that gives the same rows.

What a query reads is first written from the test tables to the shared folder in the format in question.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cli import converse, run_batch
from graphloom.errors import GraphQueryError
from graphloom.functions import dictionary
from graphloom.plans.emit import to_cypher, to_mql, to_pattern
from graphloom.plans.graph import PropertyGraph
from graphloom.plans.parser import parse, read_queries
from graphloom.plans.planner import match
from graphloom.session import shared_folder
from graphloom.sources import cypher, export, lsqb, store, tsv, wikidata
from graphloom.sources.tables import opened_graph


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/graphloom-{name}-{uuid4().hex}"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node rows of ``nodes_tsv``, without properties."""
    rows = _table(spark, sf, "nodes_tsv").filter("variable IS NOT NULL")
    labels = F.filter(F.split(F.coalesce("labels", F.lit("")), ":"), lambda x: x != "")
    return rows.select(F.col("variable").alias("id"), labels.alias("labels"), F.create_map().cast("map<string,string>").alias("props"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "edges_tsv").filter("from_id IS NOT NULL AND type IS NOT NULL AND to_id IS NOT NULL")
    return rows.select(F.col("from_id").alias("src"), F.col("type").alias("label"), F.col("to_id").alias("dst"), tsv.split_properties(F.col("properties")).alias("props"))


@lru_cache(maxsize=8)
def _stored(application: str, spark: SparkSession, sf: str) -> PropertyGraph:
    path = _folder(spark, "store")
    store.build(_nodes(spark, sf), _edges(spark, sf), path)
    return store.load(spark, path)


def stored_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """The graph of the TSV tables, built once for an application and folder, as an index is, and opened from there."""
    return _stored(spark.sparkContext.applicationId, spark, sf)


# import


def tsv_node_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line a stated property: id, labels and ``key:value``, written and parsed again."""
    nodes = _table(spark, sf, "nodes_tsv").select("variable", "labels").distinct()
    props = _table(spark, sf, "node_props").filter("NOT value RLIKE '[\\\\t\\\\n\\\\r]'").select("variable", "key", "value")
    lines = nodes.join(props, "variable").select(F.concat_ws("\t", "variable", F.coalesce("labels", F.lit("")), F.concat("key", F.lit(":"), "value")).alias("value"))
    path = _folder(spark, "lines")
    lines.write.text(path)
    return tsv.parse_node_lines(spark.read.text(path)).select("id", F.array_join("labels", ":").alias("labels"), F.explode("props").alias("key", "value"))


def tsv_edge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Edge lines written and parsed again, those with an unknown end dropped: edges and properties per type."""
    prefix = _folder(spark, "graph")
    tsv.write_tsv(_nodes(spark, sf), _edges(spark, sf), prefix)
    nodes, edges = tsv.read_tsv(spark, prefix)
    kept = tsv.with_known_ends(nodes, edges)
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.size("props")).cast("long").alias("n_props"), F.count_if(F.element_at("props", "rank") == '"preferred"').alias("n_preferred"))


def cypher_lines(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE statements, one a line, of nodes and edges of customers and orders, read again."""
    customer, orders = _table(spark, sf, "customer"), _table(spark, sf, "orders")
    nodes = customer.select(F.format_string('CREATE (C%d:Customer:%s {name: "%s", nation: %d});', "c_custkey", "c_mktsegment", "c_name", "c_nationkey").alias("value"))
    edges = orders.select(F.format_string("CREATE (C%d)-[:PLACED {status: '%s'}]->(O%d)", "o_custkey", "o_orderstatus", "o_orderkey").alias("value"))
    path = _folder(spark, "cypher")
    nodes.unionByName(edges).write.text(path)
    found, links = cypher.read_cypher(spark, path)
    left = found.select("id", F.array_join("labels", ":").alias("what"), F.element_at("props", "name").alias("text"), F.element_at("props", "nation").cast("long").alias("number"))
    return left.unionByName(links.select(F.col("src").alias("id"), F.concat_ws(":", "label", "dst").alias("what"), F.element_at("props", "status").alias("text"), F.lit(None).cast("long").alias("number")))


def cypher_script(spark: SparkSession, sf: str) -> DataFrame:
    """A script whose statements span lines, with comments and lists, read as one text."""
    nation = _table(spark, sf, "nation").select(F.format_string("// nation %d\nCREATE\n  (N%d:Nation {tags: ['%s', 'x'], key: %d})\n -[:IN_REGION]->(R%d);", *(F.col(c) for c in ("n_nationkey", "n_nationkey", "n_name", "n_nationkey", "n_regionkey"))).alias("value"))
    path = _folder(spark, "script")
    nation.coalesce(1).write.text(path)
    nodes, edges = cypher.read_cypher(spark, path, statements_span_lines=True)
    nodes = nodes.select("id", F.array_join("labels", ":").alias("label"), F.element_at("props", "tags").alias("tag"))
    return nodes.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("region")), "id")


def social_network_files(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files of a social network, made of the TSV tables and one row more each, read again: rows per label and type."""
    nodes, edges = _nodes(spark, sf).select("id").distinct(), _edges(spark, sf)
    kinds = spark.createDataFrame([(k,) for k in lsqb.NODE_FILES], "kind string")
    number = lambda c: F.regexp_extract(c, r"^[A-Za-z]+_([0-9]+)$", 1)
    kind = lambda c: F.regexp_extract(c, r"^([A-Za-z]+)_[0-9]+$", 1)
    rows = nodes.select(kind("id").alias("kind"), number("id").alias("id")).join(F.broadcast(kinds), "kind").unionByName(kinds.withColumn("id", F.lit("x")))
    path = _folder(spark, "social")
    rows.select(F.col("kind").alias("file"), "id").write.partitionBy("file").option("sep", "|").option("header", True).csv(f"{path}/nodes")
    files = spark.createDataFrame([(f, t, *(f.split("_")[i] for i in (0, 2))) for t, own in lsqb.EDGE_FILES.items() for f in own], "file string, label string, source string, target string")
    links = edges.select("label", kind("src").alias("source"), kind("dst").alias("target"), number("src").alias("src"), number("dst").alias("dst")).join(F.broadcast(files), ["label", "source", "target"])
    links = links.select("file", "src", "dst").unionByName(files.select("file", F.lit("x").alias("src"), F.lit("x").alias("dst")))
    links.write.partitionBy("file").option("sep", "|").option("header", True).csv(f"{path}/edges")
    nodes, edges = lsqb.read_lsqb(spark, path, node_path="nodes/file={}", edge_path="edges/file={}")
    per_label = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return per_label.unionByName(edges.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def wikidata_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON dump with one entity a line, made of the edges between items, read again."""
    edges = _table(spark, sf, "edges_tsv").filter("from_id LIKE 'Q%' AND to_id LIKE 'Q%' AND type LIKE 'P%'")
    value = F.struct(F.lit("item").alias("entity-type"), F.col("to_id").alias("id"))
    statement = F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak"), F.lit("normal").alias("rank"))
    entity = F.to_json(F.struct(F.col("from_id").alias("id"), F.create_map("type", F.array(statement)).alias("claims")))
    path = _folder(spark, "dump")
    edges.select(F.concat(entity, F.lit(",")).alias("value")).write.text(path)
    return wikidata.read_wikidata(spark, path)[1].select("src", "label", "dst", F.element_at("props", "rank").alias("rank"))


# export


def export_cypher_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return export.nodes_to_cypher(tsv.merged_nodes(_nodes(spark, sf)))


def export_cypher_edges(spark: SparkSession, sf: str) -> DataFrame:
    return export.edges_to_cypher(_edges(spark, sf))


def export_mql_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return export.nodes_to_mql(tsv.merged_nodes(_nodes(spark, sf)))


def export_mql_edges(spark: SparkSession, sf: str) -> DataFrame:
    return export.edges_to_mql(_edges(spark, sf))


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes and orders as edges to their nation, with properties of every kind."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = lambda c: F.col(c).cast("string")
    props = F.create_map(F.lit("name"), quoted("c_name"), F.lit("nation"), text("c_nationkey"), F.lit("segment"), quoted("c_mktsegment"))
    nodes = _table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), props.alias("props"))
    day = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    props = F.create_map(F.lit("status"), quoted("o_orderstatus"), F.lit("placed"), day)
    edges = _table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.lit("PLACED").alias("label"), F.concat(F.lit("O"), "o_orderkey").alias("dst"), props.alias("props"))
    return nodes, edges


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = _folder(spark, "table")
    export.write_table(df, path)
    return spark.read.schema(", ".join(f"`{c}` string" for c in df.columns)).option("sep", "\t").option("header", True).csv(path)


def export_bulk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, export.to_bulk_tables(*_orders(spark, sf))[0])


def export_bulk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, export.to_bulk_tables(*_orders(spark, sf))[1])


def export_bulk_compact(spark: SparkSession, sf: str) -> DataFrame:
    nodes = export.to_bulk_tables(*_orders(spark, sf), compact=True)[0]
    said = F.from_json("properties:string", "name string, segment string")
    return nodes.select("id:ID", ":LABEL", "nation:long", said["name"].alias("name"), said["segment"].alias("segment"))


def export_unwind(spark: SparkSession, sf: str) -> DataFrame:
    """Edges per type in the UNWIND statements, and whether no statement holds more than its share."""
    statements = export.to_unwind_batches(_edges(spark, sf), 100)
    rows = F.size(F.split("value", r'\{a: "')) - 1
    return statements.select(F.regexp_extract("value", r"CREATE \(a\)-\[e:(\w+)\]", 1).alias("label"), rows.alias("rows")).groupBy("label").agg(F.sum("rows").alias("n_edges"), (F.max("rows") <= 100).alias("small"))


# query texts


_TEXTS = (
    '(?p:Person)-[?e:KNOWS]->(?q) WHERE (?p.age > 30) AND (?q.name != "Bo")',
    "(?p :Person :Staff)-[:LIKES]->(m7)",
    "(?a)-[?e]->(?b) WHERE (?e.at < ZONED_DATETIME('2000-01-01T00:00:00Z')) OR (?a.x IS NULL) RETURN ?a LIMIT 3",
)
_BAD = (
    "(?a)<-[?e]-(?b)", "(?a)-[?e]->(?a)", "(?a)-[?a]->(?b)", "(?a:Nowhere)-[?e]->(?b)", "(?a)-[?e:NOTHING]->(?b)", "(?a)-[?e]->(?b) WHERE (?a.nothing = 1)", "(?a)-[?e]->(?b) WHERE (?c = ?a)",
    "(?a)-[?e:IN_REGION]->(R99)", "(?a)-[?e]->(?b) WHERE (1 = 2)", "(N1)-[:IN_REGION]->(R1)", "(?a)-[?e]->(?b) WHERE (?a = ?e)",
)


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Queries in the three dialects."""
    return spark.createDataFrame([(i, to_pattern(q), to_mql(q), to_cypher(q)) for i, q in enumerate(map(parse, _TEXTS))], "number long, pattern string, mql string, cypher string")


def refused_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that say what may not be said, refused before any join."""
    graph, out = opened_graph(spark, sf), []
    for number, text in enumerate(_BAD):
        try:
            match(graph, text)
            out.append((number, False))
        except GraphQueryError:
            out.append((number, True))
    return spark.createDataFrame(out, "number long, refused boolean")


# stored graphs and run control


def store_node_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by their numbers in a stored graph."""
    return match(stored_graph(spark, sf), "(?a)-[?e:KNOWS]->(?b) WHERE (?a <= 200) AND (?b > 20) RETURN ?a, ?b")


def store_edge_constant(spark: SparkSession, sf: str) -> DataFrame:
    """The edge of a number in a stored graph."""
    return match(stored_graph(spark, sf), "(?a)-[7]->(?b)")


def store_edge_property(spark: SparkSession, sf: str) -> DataFrame:
    """A condition on an edge property that reaches the Parquet reader."""
    return match(stored_graph(spark, sf), '(?a)-[?e:KNOWS]->(?b) WHERE (?e.rank = "preferred") RETURN ?a, ?b')


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A query file run as a batch, each query twice and within a time limit: results per query, 0 for a refused one."""
    texts = ["  (?n)-[?e:IN_REGION]->(?r) ", "", "(?c:Customer)-[?e:PLACED]->(?o) WHERE (?o.totalprice > 300000)", "(?a)-[?e:NO_SUCH]->(?b)", "(?s:Supplier)-[?e:IN_NATION]->(N3)"]
    with tempfile.TemporaryDirectory() as folder:  # a query file lies beside the driver
        path = os.path.join(folder, "queries.txt")
        with open(path, "w", encoding="utf-8") as out:
            out.write("\n".join(texts))
        rows = list(run_batch(opened_graph(spark, sf), read_queries(path), limit=1000, timeout=600.0, repeat=2, complain=lambda text: None))
    return spark.createDataFrame([(number, count) for number, count, _ in rows], "number long, n_results long")


def asked_query(spark: SparkSession, sf: str) -> DataFrame:
    """A query asked in the interactive mode, as its answer is written."""
    path = _folder(spark, "asked")
    converse(opened_graph(spark, sf), ["(?n)-[:IN_REGION]->(?r) RETURN ?n, ?r, ?n.name AS name", "exit", "(?x"], say=lambda text: None, out=path)
    return spark.read.schema("n string, r string, name string").option("sep", "\t").option("header", True).csv(f"{path}/0")


def dict_contains_size(spark: SparkSession, sf: str) -> DataFrame:
    names = dictionary.build(_table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id")), "id")
    return spark.createDataFrame([(dictionary.contains(names, "P77"), dictionary.contains(names, "Q77"), dictionary.size(names))], "has_p77 boolean, has_q77 boolean, n long")


def _labels_sql() -> str:
    return "(SELECT variable AS id, list_sort(list_distinct(list_filter(flatten(list(string_split(coalesce(labels, ''), ':'))), lambda x: x <> ''))) AS labels FROM nodes_tsv WHERE variable IS NOT NULL GROUP BY variable)"


_KV = """list_filter(list_transform(string_split(coalesce(properties, ''), chr(9)), lambda x: {'k': trim(split_part(trim(x), ':', 1)), 'v': trim(substr(trim(x), strpos(trim(x), ':') + 1)), 'ok': strpos(trim(x), ':') > 0}), lambda e: e.ok AND e.k <> '')"""
_EDGE = f"(SELECT *, list_sort(list_distinct(list_transform(kv, lambda e: e.k))) AS keys FROM (SELECT edge_id, from_id, type, to_id, {_KV} AS kv FROM edges_tsv WHERE from_id IS NOT NULL AND type IS NOT NULL AND to_id IS NOT NULL))"
_LAST = "list_filter(kv, lambda e: e.k = k)[-1].v"
_DATE = r"'[+-]?[0-9]{4,9}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?'"
_FIXED = r"regexp_replace(regexp_replace(" + _LAST + r", '^([+-]?[0-9]+)-00-', '\1-01-'), '^([+-]?[0-9]+-[0-9]{2})-00T', '\1-01T')"
_KNOWN = "from_id IN (SELECT variable FROM nodes_tsv) AND to_id IN (SELECT variable FROM nodes_tsv)"
_RANKED = "(SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT variable AS id FROM nodes_tsv WHERE variable IS NOT NULL))"


def _social_sql() -> str:
    files = ", ".join(f"('{t}', '{f.split('_')[0]}', '{f.split('_')[2]}')" for t, own in lsqb.EDGE_FILES.items() for f in own)
    kinds = ", ".join(f"('{kind}', '{label}')" for kind, labels in lsqb.NODE_FILES.items() for label in labels)
    part = lambda c: f"regexp_extract({c}, '^([A-Za-z]+)_[0-9]+$', 1)"
    return f"""WITH f(label, source, target) AS (VALUES {files}), k(kind, label) AS (VALUES {kinds}), n AS (SELECT {part('variable')} AS kind, count(DISTINCT variable) AS n FROM nodes_tsv GROUP BY 1), e AS (SELECT type AS label, {part('from_id')} AS source, {part('to_id')} AS target, count(*) AS n FROM edges_tsv GROUP BY ALL)
        SELECT k.label AS name, sum(coalesce(n.n, 0) + 1)::BIGINT AS n FROM k LEFT JOIN n USING (kind) GROUP BY 1 UNION ALL SELECT f.label, sum(coalesce(e.n, 0) + 1)::BIGINT FROM f LEFT JOIN e USING (label, source, target) GROUP BY 1"""


_CYPHER = (
    """MATCH (p:Entity:Person)-[e:KNOWS]->(q:Entity) WHERE (p.age > 30) AND (q.name <> "Bo") RETURN p.qid, id(e), q.qid""",
    """MATCH (p:Entity:Person:Staff)-[:LIKES]->(fixed1:Entity { qid: "m7"}) RETURN p.qid""",
    """MATCH (a:Entity)-[e]->(b:Entity) WHERE ((e.at < datetime('2000-01-01T00:00:00Z')) OR (a.x IS NULL)) RETURN a.qid LIMIT 3""",
)
_MQL = (
    """MATCH (?p :Person)-[?e :KNOWS]->(?q) WHERE (?p.age > 30) AND (?q.name != "Bo") RETURN ?p, ?e, ?q""",
    """MATCH (?p :Person :Staff)-[ :LIKES]->(m7) RETURN ?p""",
    """MATCH (?a)-[?e]->(?b) WHERE ((?e.at < dateTimeStamp("2000-01-01T00:00:00Z")) OR (?a.x IS NULL)) RETURN ?a LIMIT 3""",
)
_PATTERN = (
    """(?p:Person)-[?e:KNOWS]->(?q) WHERE (?p.age > 30) AND (?q.name != "Bo")""",
    """(?p:(Person AND Staff))-[:LIKES]->(m7)""",
    """(?a)-[?e]->(?b) WHERE ((?e.at < ZONED_DATETIME('2000-01-01T00:00:00Z')) OR (?a.x IS NULL)) RETURN ?a LIMIT 3""",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CUSTOMER_ROW = """SELECT 'C' || c_custkey AS "id:ID", 'Entity;Customer' AS ":LABEL" """
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "tsv_node_lines": (
        tsv_node_lines,
        """SELECT trim(n.variable) AS id, array_to_string(list_filter(list_transform(string_split(coalesce(labels, ''), ':'), lambda x: trim(x)), lambda x: x <> ''), ':') AS labels, trim(split_part(line, ':', 1)) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value
        FROM (SELECT DISTINCT variable, labels FROM nodes_tsv) n JOIN (SELECT variable, trim(key || ':' || value) AS line FROM node_props WHERE NOT regexp_matches(value, '[\\t\\n\\r]')) p USING (variable) WHERE trim(split_part(line, ':', 1)) <> ''""",
    ),
    "tsv_edge_lines": (tsv_edge_lines, f"""SELECT type AS label, count(*) AS n_edges, sum(len(keys))::BIGINT AS n_props, count(*) FILTER (list_filter(kv, lambda e: e.k = 'rank')[-1].v = '"preferred"') AS n_preferred FROM {_EDGE} WHERE {_KNOWN} GROUP BY 1"""),
    "cypher_lines": (
        cypher_lines,
        """SELECT 'C' || c_custkey AS id, 'Customer:' || c_mktsegment AS what, '"' || c_name || '"' AS text, c_nationkey::BIGINT AS number FROM customer UNION ALL SELECT 'C' || o_custkey, 'PLACED:O' || o_orderkey, '"' || o_orderstatus || '"', NULL FROM orders""",
    ),
    "cypher_script": (cypher_script, """SELECT 'N' || n_nationkey AS id, 'Nation' AS label, '"' || n_name || '"' AS tag, 'R' || n_regionkey AS region FROM nation"""),
    "social_network_files": (social_network_files, _social_sql()),
    "wikidata_dump": (wikidata_dump, """SELECT from_id AS src, type AS label, to_id AS dst, '"normal"' AS rank FROM edges_tsv WHERE from_id LIKE 'Q%' AND to_id LIKE 'Q%' AND type LIKE 'P%' AND type <> 'P31'"""),
    "export_cypher_nodes": (export_cypher_nodes, f"""SELECT 'CREATE (' || id || array_to_string(list_transform(labels, lambda x: ':' || x), '') || ' {{qid: "' || id || '"}});' AS value FROM {_labels_sql()}"""),
    "export_cypher_edges": (
        export_cypher_edges,
        f"""SELECT 'MATCH (a {{qid: "' || from_id || '"}}), (b {{qid: "' || to_id || '"}}) CREATE (a)-[:' || type || CASE WHEN len(keys) > 0 THEN ' {{' || array_to_string(list_transform(keys, lambda k: k || ': ' ||
        CASE WHEN regexp_full_match({_LAST}, {_DATE}) THEN 'datetime(''' || {_FIXED} || ''')' ELSE {_LAST} END), ', ') || '}}' ELSE '' END || ']->(b);' AS value FROM {_EDGE}""",
    ),
    "export_mql_nodes": (export_mql_nodes, f"SELECT id || array_to_string(list_transform(labels, lambda x: ' :' || x), '') AS value FROM {_labels_sql()}"),
    "export_mql_edges": (
        export_mql_edges,
        f"""SELECT from_id || '->' || to_id || ' :' || type || array_to_string(list_transform(keys, lambda k: ' ' || k || ':' || CASE WHEN regexp_full_match({_LAST}, {_DATE}) THEN 'dateTimeStamp("' || regexp_replace({_LAST}, '^\\+', '') || '")' ELSE {_LAST} END), '') AS value FROM {_EDGE}""",
    ),
    "export_bulk_nodes": (export_bulk_nodes, f"""{_CUSTOMER_ROW}, c_name AS "name:string", c_nationkey::VARCHAR AS "nation:long", c_mktsegment AS "segment:string" FROM customer"""),
    "export_bulk_edges": (export_bulk_edges, """SELECT 'C' || o_custkey AS ":START_ID", 'O' || o_orderkey AS ":END_ID", 'PLACED' AS ":TYPE", strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS "placed:datetime", o_orderstatus AS "status:string" FROM orders"""),
    "export_bulk_compact": (export_bulk_compact, f"""{_CUSTOMER_ROW}, c_nationkey::VARCHAR AS "nation:long", '"' || c_name || '"' AS name, '"' || c_mktsegment || '"' AS segment FROM customer"""),
    "export_unwind": (export_unwind, "SELECT type AS label, count(*) AS n_edges, true AS small FROM edges_tsv WHERE from_id IS NOT NULL AND type IS NOT NULL AND to_id IS NOT NULL GROUP BY 1"),
    "query_texts": (query_texts, " UNION ALL ".join(f"SELECT {i}::BIGINT AS number, {_text(p)} AS pattern, {_text(m)} AS mql, {_text(c)} AS cypher" for i, (p, m, c) in enumerate(zip(_PATTERN, _MQL, _CYPHER)))),
    "refused_queries": (refused_queries, f"SELECT range AS number, true AS refused FROM range({len(_BAD)})"),
    "store_node_numbers": (store_node_numbers, f"SELECT a.id AS a, b.id AS b FROM edges_tsv JOIN {_RANKED} a ON a.id = from_id JOIN {_RANKED} b ON b.id = to_id WHERE type = 'KNOWS' AND a.n <= 200 AND b.n > 20"),
    "store_edge_constant": (store_edge_constant, f"SELECT from_id AS a, to_id AS b FROM (SELECT *, row_number() OVER (ORDER BY type, to_id, from_id) AS n FROM edges_tsv WHERE type IS NOT NULL AND {_KNOWN}) WHERE n = 7"),
    "store_edge_property": (store_edge_property, f"""SELECT from_id AS a, to_id AS b FROM {_EDGE} WHERE type = 'KNOWS' AND {_KNOWN} AND list_filter(kv, lambda e: e.k = 'rank')[-1].v = '"preferred"'"""),
    "batch_summary": (
        batch_summary,
        """SELECT 1::BIGINT AS number, (SELECT least(count(*), 1000) FROM nation) AS n_results UNION ALL SELECT 2, (SELECT least(count(*), 1000) FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT 3, 0
        UNION ALL SELECT 4, (SELECT least(count(*), 1000) FROM supplier WHERE s_nationkey = 3)""",
    ),
    "asked_query": (asked_query, "SELECT 'N' || n_nationkey AS n, 'R' || n_regionkey AS r, n_name AS name FROM nation"),
    "dict_contains_size": (dict_contains_size, "SELECT (SELECT count(*) FROM part WHERE p_partkey = 77) > 0 AS has_p77, false AS has_q77, (SELECT count(DISTINCT p_partkey) FROM part) AS n"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in ALL.items()}
ORACLE: dict[str, str] = {k: sql for k, (_, sql) in ALL.items()}
