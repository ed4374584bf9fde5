"""Pattern queries over the star-schema graph, one for each operator of the language, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dictionary
from graphloom.io_queries import stored_graph
from graphloom.plans.planner import match
from graphloom.sources.tables import opened_graph


@dataclass(frozen=True)
class PatternQuery:
    """A pattern, how to run it, and the SQL that gives the same rows."""

    pattern: str
    sql: str
    mode: str = "interleaved"
    edge_semantics: str = "homomorphism"
    strategy: str = "auto"

    def __call__(self, spark: SparkSession, sf: str) -> DataFrame:
        return match(opened_graph(spark, sf), self.pattern, mode=self.mode, edge_semantics=self.edge_semantics, strategy=self.strategy)


LOCAL_SUPPLIER = "(?c:Customer)-[?e1:IN_NATION]->(?n:Nation), (?s:Supplier)-[?e2:IN_NATION]->(?n:Nation), (?c:Customer)-[?e3:PLACED]->(?o:Order), (?o:Order)-[?e4:SHIPPED_BY]->(?s:Supplier)"
_LOCAL_SQL = """SELECT 'C' || c_custkey AS c, 'N' || c_nationkey AS n, 'S' || s_suppkey AS s, 'O' || o_orderkey AS o
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"""
_SQUARE = "(?a)-[?e1:CONTAINS]->(?p), (?b)-[?e2:CONTAINS]->(?p), (?a)-[?e3:CONTAINS]->(?q), (?b)-[?e4:CONTAINS]->(?q) WHERE (?a < ?b) AND (?p < ?q) RETURN ?a, ?b, ?p, ?q"
_SQUARE_SQL = """WITH x AS MATERIALIZED (SELECT l.l_orderkey AS o, l.l_partkey AS p, r.l_partkey AS q FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey WHERE l.l_partkey <> r.l_partkey AND 'P' || l.l_partkey < 'P' || r.l_partkey)
        SELECT 'O' || x.o AS a, 'O' || y.o AS b, 'P' || x.p AS p, 'P' || x.q AS q FROM x JOIN x y ON x.p = y.p AND x.q = y.q WHERE 'O' || x.o < 'O' || y.o"""
_BIG = "(?c:Customer)-[:PLACED]->(?o:Order) WHERE (?o.totalprice > 300000.0) AND (?c.acctbal < 0) RETURN ?c, ?o, ?o.totalprice AS price"
_BIG_SQL = "SELECT 'C' || c_custkey AS c, 'O' || o_orderkey AS o, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000.0 AND c_acctbal < 0"


def _order_test(op: str) -> PatternQuery:
    return PatternQuery(
        f"(?c)-[:PLACED]->(?o:Order) WHERE (?o.totalprice {op} 150000.5) RETURN ?o, ?o.totalprice AS price",
        f"SELECT 'O' || o_orderkey AS o, o_totalprice AS price FROM orders WHERE o_totalprice {op} 150000.5",
    )


PATTERNS: dict[str, PatternQuery] = {
    "scan_label": PatternQuery("(?c:Customer)-[:IN_NATION]->(?n) RETURN ?c, ?c.name AS name, ?c.acctbal AS acctbal", "SELECT 'C' || c_custkey AS c, c_name AS name, c_acctbal AS acctbal FROM customer"),
    "node_label_and": PatternQuery("(?c:(Party AND BUILDING))-[:IN_NATION]->(?n) RETURN ?c, ?n", "SELECT 'C' || c_custkey AS c, 'N' || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "node_label_or": PatternQuery(
        "(?o)-[?e:CONTAINS]->(?p:(ECONOMY OR PROMO)) RETURN ?o, ?p, ?e.quantity AS quantity",
        "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS p, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('ECONOMY', 'PROMO')",
    ),
    "node_label_not": PatternQuery("(?c:(Customer AND NOT MACHINERY))-[:IN_NATION]->(?n) RETURN ?c", "SELECT 'C' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'MACHINERY'"),
    "node_label_list": PatternQuery("MATCH (?c :Party :FURNITURE)-[:IN_NATION]->(N3) RETURN ?c", "SELECT 'C' || c_custkey AS c FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_nationkey = 3"),
    "edge_single_type": PatternQuery("(?c)-[?e:PLACED]->(?o) RETURN ?c, ?o", "SELECT 'C' || o_custkey AS c, 'O' || o_orderkey AS o FROM orders"),
    "edge_type_or": PatternQuery("(?a)-[?e:(IN_NATION OR IN_REGION)]->(?b) RETURN ?a, ?b", "SELECT 'C' || c_custkey AS a, 'N' || c_nationkey AS b FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"),
    "edge_type_not": PatternQuery("(?a:Party)-[?e:(NOT PLACED AND NOT DID)]->(?b) RETURN ?a, ?b", "SELECT 'C' || c_custkey AS a, 'N' || c_nationkey AS b FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier"),
    "edge_any_type": PatternQuery("(?o:Order)-[?e]->(?x) RETURN ?o, ?x", "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS x FROM lineitem UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem"),
    "edge_type_contradiction": PatternQuery("(?a)-[?e:(PLACED AND DID)]->(?b) RETURN ?a, ?b", "SELECT '' AS a, '' AS b WHERE false"),
    "const_dst": PatternQuery("(?x)-[?e:IN_NATION]->(N7) RETURN ?x", "SELECT 'C' || c_custkey AS x FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 7"),
    "const_src": PatternQuery("(O1)-[?e:CONTAINS]->(?p) RETURN ?p, ?e.quantity AS quantity", "SELECT 'P' || l_partkey AS p, l_quantity AS quantity FROM lineitem WHERE l_orderkey = 1"),
    "const_both": PatternQuery("(N3)-[?e:IN_REGION]->(R3), (?s:Supplier)-[:IN_NATION]->(N3) RETURN ?s", "SELECT 'S' || s_suppkey AS s FROM supplier, nation WHERE s_nationkey = 3 AND n_nationkey = 3 AND n_regionkey = 3"),
    "const_label": PatternQuery("(?c)-[:IN_NATION]->(N3:Nation) RETURN ?c", "SELECT 'C' || c_custkey AS c FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 3"),
    "const_wrong_label": PatternQuery("(?c)-[:IN_NATION]->(N3:Region) RETURN ?c", "SELECT '' AS c WHERE false"),
    "chain_3": PatternQuery(
        "(?c:Customer)-[:IN_NATION]->(?n), (?n)-[:IN_REGION]->(?r), (?c)-[?e:PLACED]->(?o) RETURN ?c, ?n, ?r, ?o",
        "SELECT 'C' || c_custkey AS c, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r, 'O' || o_orderkey AS o FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey",
    ),
    "star_4": PatternQuery(
        "(?o)-[?a:CONTAINS]->(?p:PROMO), (?o)-[:SHIPPED_BY]->(?s), (?c:BUILDING)-[:PLACED]->(?o), (?c)-[:IN_NATION]->(?n) WHERE (?a.quantity >= 45) RETURN ?o, ?p, ?s, ?c, ?n, ?a.quantity AS quantity",
        """SELECT 'O' || a.l_orderkey AS o, 'P' || a.l_partkey AS p, 'S' || s.l_suppkey AS s, 'C' || c_custkey AS c, 'N' || c_nationkey AS n, a.l_quantity AS quantity
        FROM lineitem a JOIN part ON p_partkey = a.l_partkey AND p_type = 'PROMO' JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) s ON s.l_orderkey = a.l_orderkey
        JOIN orders ON o_orderkey = a.l_orderkey JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' WHERE a.l_quantity >= 45""",
    ),
    "snowflake": PatternQuery(
        "(?o)-[?l:SHIPPED_BY]->(?s), (?s)-[:IN_NATION]->(?sn), (?sn)-[:IN_REGION]->(?r), (?c)-[:PLACED]->(?o), (?c)-[:IN_NATION]->(?cn), (?cn)-[:IN_REGION]->(?r) WHERE (?o.totalprice > 400000) RETURN ?o, ?s, ?sn, ?r, ?c, ?cn",
        """SELECT 'O' || o_orderkey AS o, 'S' || s_suppkey AS s, 'N' || s_nationkey AS sn, 'R' || a.n_regionkey AS r, 'C' || c_custkey AS c, 'N' || c_nationkey AS cn
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey AND b.n_regionkey = a.n_regionkey WHERE o_totalprice > 400000""",
    ),
    "cycle_local_supplier": PatternQuery(LOCAL_SUPPLIER + " RETURN ?c, ?n, ?s, ?o", _LOCAL_SQL),
    "cycle_square_parts": PatternQuery(_SQUARE, _SQUARE_SQL),
    "cycle_square_multiway": PatternQuery(_SQUARE, _SQUARE_SQL, strategy="multiway"),
    "cycle_local_multiway": PatternQuery(LOCAL_SUPPLIER + " RETURN ?c, ?n, ?s, ?o", _LOCAL_SQL, strategy="multiway"),
    "parallel_edges_distinct": PatternQuery(
        "(?o)-[?a:CONTAINS]->(?p), (?o)-[?b:CONTAINS]->(?p) RETURN ?o, ?p, ?a.quantity AS qa, ?b.quantity AS qb",
        "WITH l AS (SELECT *, row_number() OVER () AS i FROM lineitem) SELECT 'O' || a.l_orderkey AS o, 'P' || a.l_partkey AS p, a.l_quantity AS qa, b.l_quantity AS qb FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.i <> b.i",
        edge_semantics="distinct",
    ),
    "parallel_edges_homomorphism": PatternQuery(
        "(?o)-[?a:CONTAINS]->(?p), (?o)-[?b:CONTAINS]->(?p) RETURN ?o, ?p, ?a.quantity AS qa, ?b.quantity AS qb",
        "SELECT 'O' || a.l_orderkey AS o, 'P' || a.l_partkey AS p, a.l_quantity AS qa, b.l_quantity AS qb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey",
    ),
    "edge_variable_twice": PatternQuery("(?a)-[?e:IN_NATION]->(?n), (?b)-[?e:IN_NATION]->(?m) RETURN ?a, ?b, ?n, ?m", "SELECT 'C' || c_custkey AS a, 'C' || c_custkey AS b, 'N' || c_nationkey AS n, 'N' || c_nationkey AS m FROM customer UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, 'N' || s_nationkey FROM supplier"),
    "anonymous_edge_exists": PatternQuery("(?o:Order)-[:SHIPPED_BY]->(?s) RETURN ?o, ?s", "SELECT DISTINCT 'O' || l_orderkey AS o, 'S' || l_suppkey AS s FROM lineitem"),
    "anonymous_node": PatternQuery("(?c:Customer)-[:PLACED]->(:Order), (?c)-[:DID]->() RETURN ?c", "SELECT 'C' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)"),
    "cross_product_small": PatternQuery("(?r)-[?a:IN_REGION]->(R1), (?x)-[?b:IN_REGION]->(R2) RETURN ?r, ?x", "SELECT 'N' || a.n_nationkey AS r, 'N' || b.n_nationkey AS x FROM nation a CROSS JOIN nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 2"),
    **{f"prop_{name}_const": _order_test(op) for name, op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))},
    "prop_eq_const": PatternQuery("(?c)-[:PLACED]->(?o) WHERE (?o.status = 'F') RETURN ?o", "SELECT 'O' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'"),
    "prop_ne_const": PatternQuery("(?c)-[:DID]->(?e) WHERE (?e.purchase_value != 10.5) RETURN ?e", "SELECT 'E' || event_id AS e FROM events WHERE event_type = 'purchase' AND value <> 10.5"),
    "prop_string_order": PatternQuery(
        "(?o)-[?e:CONTAINS]->(?p) WHERE (?p.brand >= \"Brand#3\") AND (?e.linenumber = 1) RETURN ?o, ?p",
        "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand >= 'Brand#3' AND l_linenumber = 1",
    ),
    "prop_datetime_const": PatternQuery("(?c)-[:PLACED]->(?o) WHERE (?o.orderdate < ZONED_DATETIME('1996-01-01T00:00:00Z')) RETURN ?o", "SELECT 'O' || o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"),
    "prop_datetime_partial": PatternQuery("(?c)-[:PLACED]->(?o) WHERE (?o.orderdate >= \"2000-00-00T00:00:00Z\") RETURN ?o", "SELECT 'O' || o_orderkey AS o FROM orders WHERE year(o_orderdate) >= 2000"),
    "prop_range_fused": PatternQuery("(?o)-[?e:CONTAINS]->(?p) WHERE (?e.quantity >= 10) AND (?e.quantity < 12) RETURN ?o, ?p, ?e.quantity AS quantity", "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS p, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12"),
    "prop_range_empty": PatternQuery("(?o)-[?e:CONTAINS]->(?p) WHERE (?e.quantity > 20) AND (?e.quantity < 10) RETURN ?o", "SELECT '' AS o WHERE false"),
    "prop_is_null": PatternQuery("(?c)-[:DID]->(?e) WHERE (?e.purchase_value IS NULL) RETURN ?e", "SELECT 'E' || event_id AS e FROM events WHERE event_type <> 'purchase'"),
    "prop_is_not_null": PatternQuery("(?c)-[:DID]->(?e) WHERE (?e.purchase_value IS NOT NULL) RETURN ?e, ?e.purchase_value AS value", "SELECT 'E' || event_id AS e, value FROM events WHERE event_type = 'purchase'"),
    "prop_prop_same_var": PatternQuery("(?o)-[?e:CONTAINS]->(?p) WHERE (?e.discount > ?e.tax) RETURN ?o, ?p, ?e.discount AS discount, ?e.tax AS tax", "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS p, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_discount > l_tax"),
    "prop_prop_cross_var": PatternQuery("(?c:Customer)-[:IN_NATION]->(?n), (?s:Supplier)-[:IN_NATION]->(?n) WHERE (?c.acctbal < ?s.acctbal) AND (?n.name = ?n.name) RETURN ?c, ?s", "SELECT 'C' || c_custkey AS c, 'S' || s_suppkey AS s FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal < s_acctbal"),
    "edge_prop_vs_node_prop": PatternQuery("(?o)-[?e:CONTAINS]->(?p) WHERE (?e.extendedprice < ?p.retailprice) RETURN ?o, ?p, ?e.extendedprice AS price", "SELECT 'O' || l_orderkey AS o, 'P' || l_partkey AS p, l_extendedprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice < p_retailprice"),
    "edge_prop_vs_edge_prop": PatternQuery("(?o)-[?a:CONTAINS]->(?p), (?o)-[?b:SHIPPED_BY]->(?s) WHERE (?a.shipdate > ?b.shipdate) AND (?a.quantity = 1) RETURN ?o, ?p, ?s", "SELECT 'O' || a.l_orderkey AS o, 'P' || a.l_partkey AS p, 'S' || b.l_suppkey AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_shipdate > b.l_shipdate AND a.l_quantity = 1"),
    "id_eq": PatternQuery("(?c:Customer)-[:IN_NATION]->(?n), (?s:Supplier)-[:IN_NATION]->(?m) WHERE (?n == ?m) AND (?c.acctbal < -900) RETURN ?c, ?s, ?n", "SELECT 'C' || c_custkey AS c, 'S' || s_suppkey AS s, 'N' || c_nationkey AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal < -900"),
    "id_ne": PatternQuery("(?a)-[?x:IN_REGION]->(?r), (?b)-[?y:IN_REGION]->(?r) WHERE (?a != ?b) RETURN ?a, ?b, ?r", "SELECT 'N' || a.n_nationkey AS a, 'N' || b.n_nationkey AS b, 'R' || a.n_regionkey AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "id_lt": PatternQuery("(?a)-[?x:IN_REGION]->(?r), (?b)-[?y:IN_REGION]->(?r) WHERE (?a < ?b) RETURN ?a, ?b", "SELECT 'N' || a.n_nationkey AS a, 'N' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND 'N' || a.n_nationkey < 'N' || b.n_nationkey"),
    "id_const": PatternQuery("(?c)-[?e:IN_NATION]->(?n) WHERE (?n = N5) RETURN ?c, ?n", "SELECT 'C' || c_custkey AS c, 'N5' AS n FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 'S' || s_suppkey, 'N5' FROM supplier WHERE s_nationkey = 5"),
    "id_range": PatternQuery("(?s:Supplier)-[?e:IN_NATION]->(?n) WHERE (?s >= \"S2\") AND (?s < \"S5\") RETURN ?s", "SELECT 'S' || s_suppkey AS s FROM supplier WHERE 'S' || s_suppkey >= 'S2' AND 'S' || s_suppkey < 'S5'"),
    "where_or_nested": PatternQuery(
        "(?c:Customer)-[:PLACED]->(?o) WHERE ((?o.totalprice > 300000.0) OR (?c.acctbal > 9000)) AND ((?o.status = \"F\") OR (?o.status = \"P\") OR (?c.name = \"Customer#1\")) RETURN ?c, ?o",
        "SELECT 'C' || c_custkey AS c, 'O' || o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE (o_totalprice > 300000.0 OR c_acctbal > 9000) AND (o_orderstatus IN ('F', 'P') OR c_name = 'Customer#1')",
    ),
    "interleaved_mode": PatternQuery(_BIG, _BIG_SQL),
    "prefilter_mode": PatternQuery(_BIG, _BIG_SQL, mode="prefilter"),
    "postfilter_mode": PatternQuery(_BIG, _BIG_SQL, mode="postfilter"),
}


def _graph_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The stored TSV edges whose target is a declared node, with the nodes that they use counted per node."""
    from graphloom.sources.tsv import clean

    nodes = spark.read.parquet(f"{sf}/nodes_tsv.parquet").filter(F.col("variable").isNotNull()).select(F.col("variable").alias("id")).distinct()
    edges = spark.read.parquet(f"{sf}/edges_tsv.parquet").select("edge_id", F.col("from_id").alias("src"), F.col("type").alias("label"), F.col("to_id").alias("dst"))
    kept_nodes, kept_edges = clean(nodes, edges)
    return kept_nodes.join(kept_edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in")), "id", "left").fillna(0, ["n_in"])


def _match_count(spark: SparkSession, sf: str) -> DataFrame:
    """The number of bindings of the flagship pattern."""
    return match(opened_graph(spark, sf), LOCAL_SUPPLIER).agg(F.count(F.lit(1)).alias("n_results"))


def _tsv_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled pattern with an edge property over the stored graph of the TSV tables."""
    return match(stored_graph(spark, sf), "(?a:Person)-[?e:KNOWS]->(?b:Person) WHERE (?e.rank = \"preferred\") RETURN ?a, ?b", check_constants=False)


def _tsv_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    return match(stored_graph(spark, sf), "(?a:Person)-[?e:KNOWS]->(?b:Q5), (?b)-[?f:LIKES]->(?c:(Forum OR Message)) RETURN ?a, ?b, ?c", check_constants=False)


#: Closed wedges; one node has a tenth of all edges.
_CLOSED = "(?x)-[:KNOWS]->(?y), (?y)-[:KNOWS]->(?z), (?x)-[:KNOWS]->(?z) RETURN ?x, ?y, ?z"
_CLOSED_SQL = """WITH k AS (SELECT DISTINCT from_id AS s, to_id AS o FROM edges_tsv WHERE type = 'KNOWS' AND from_id IN (SELECT variable FROM nodes_tsv) AND to_id IN (SELECT variable FROM nodes_tsv))
        SELECT a.s AS x, a.o AS y, b.o AS z FROM k a JOIN k b ON b.s = a.o JOIN k c ON c.s = a.s AND c.o = b.o"""


def _closed(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: match(stored_graph(spark, sf), _CLOSED, strategy=strategy, check_constants=False)


def _social(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    """A pattern of the social-network benchmark over the stored graph; it is counted, as the benchmark does."""
    return lambda spark, sf: match(stored_graph(spark, sf), pattern, check_constants=False).agg(F.count(F.lit(1)).alias("n_results"))


_NODES = "(SELECT variable, list_distinct(flatten(list(string_split(coalesce(labels, ''), ':')))) AS labels FROM nodes_tsv WHERE variable IS NOT NULL GROUP BY variable)"
_RANK = "(SELECT *, list_last(list_filter(string_split(properties, chr(9)), lambda x: starts_with(x, 'rank:'))) AS rank_text FROM edges_tsv)"


def _dictionary(pick: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        names = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"))
        return pick(dictionary.build(names, "id"))

    return run


_DICT = "(SELECT 'P' || p_partkey AS id, row_number() OVER (ORDER BY 'P' || p_partkey) AS node_id FROM part)"


def _social_sql(edges: list[tuple[str, str, str]], labels: dict[str, str], where: str = "true") -> str:
    """Count of the rows where edges ``(source, type, target)`` and node labels hold together."""
    parts, seen = [], {}
    for i, (s, t, o) in enumerate(edges):
        on = [f"e{i}.type = '{t}'"]
        for v, c in ((s, "from_id"), (o, "to_id")):
            if v in seen:
                on.append(f"e{i}.{c} = {seen[v]}")
            seen.setdefault(v, f"e{i}.{c}")
        parts.append(f"JOIN e e{i} ON {' AND '.join(on)}" if i else f"FROM e e{i}")
    tests = [f"{seen[v]} IN (SELECT variable FROM n WHERE list_contains(labels, '{x}'))" for v, x in labels.items()]
    known = [f"{c} IN (SELECT variable FROM n)" for v, c in seen.items() if v not in labels]
    for v in seen:
        where = where.replace(f"?{v}", seen[v])
    return f"WITH n AS MATERIALIZED {_NODES}, e AS (SELECT * FROM edges_tsv) SELECT count(*) AS n_results {' '.join(parts)} WHERE e0.type = '{edges[0][1]}' AND {' AND '.join([*tests, *known, where])}"


#: The six benchmark questions over a social network: edges, labels and a condition.
_BENCHMARK: dict[str, tuple[list[tuple[str, str, str]], dict[str, str], str]] = {
    "social_q1": ([("town", "IS_PART_OF", "land"), ("man", "IS_LOCATED_IN", "town"), ("forum", "HAS_MEMBER", "man"), ("forum", "CONTAINER_OF", "post"), ("reply", "REPLY_OF", "post"), ("reply", "HAS_TAG", "tag"), ("tag", "HAS_TYPE", "kind")], {"town": "City", "man": "Person", "forum": "Forum", "post": "Post", "reply": "Comment", "tag": "Tag"}, ""),
    "social_q2": ([("x", "KNOWS", "y"), ("reply", "HAS_CREATOR", "x"), ("reply", "REPLY_OF", "post"), ("post", "HAS_CREATOR", "y")], {"x": "Person", "y": "Person", "reply": "Comment", "post": "Post"}, ""),
    "social_q3": ([("x", "KNOWS", "y"), ("y", "KNOWS", "z"), ("z", "KNOWS", "x")], {"x": "Person", "y": "Person", "z": "Person"}, ""),
    "social_q4": ([("m", "HAS_TAG", "tag"), ("m", "HAS_CREATOR", "maker"), ("fan", "LIKES", "m"), ("reply", "REPLY_OF", "m")], {"m": "Message", "reply": "Comment"}, ""),
    "social_q5": ([("m", "HAS_TAG", "one"), ("reply", "REPLY_OF", "m"), ("reply", "HAS_TAG", "two")], {"m": "Message"}, "?one != ?two"),
    "social_q6": ([("x", "KNOWS", "y"), ("y", "KNOWS", "z"), ("z", "HAS_TAG", "tag")], {"x": "Person", "y": "Person"}, "?x != ?z"),
}


def _pattern_of(edges: list[tuple[str, str, str]], labels: dict[str, str], where: str) -> str:
    node = lambda v: f"(?{v}{':' + labels[v] if v in labels else ''})"
    text = ", ".join(f"{node(s)}-[?e{i}:{t}]->{node(o)}" for i, (s, t, o) in enumerate(edges))
    return f"{text} WHERE ({where}) RETURN ?{edges[0][0]}" if where else f"{text} RETURN ?{edges[0][0]}"


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "match_count": (_match_count, f"SELECT count(*) AS n_results FROM ({_LOCAL_SQL})"),
    "clean_graph": (
        _graph_cleaned,
        """WITH n AS (SELECT DISTINCT variable AS id FROM nodes_tsv WHERE variable IS NOT NULL), e AS (SELECT * FROM edges_tsv WHERE to_id IN (SELECT id FROM n))
        SELECT id, (SELECT count(*) FROM e WHERE to_id = id) AS n_in FROM n WHERE id IN (SELECT from_id FROM e) OR id IN (SELECT to_id FROM e)""",
    ),
    "tsv_pattern": (
        _tsv_pattern,
        f"""SELECT a.variable AS a, b.variable AS b FROM {_RANK} e JOIN {_NODES} a ON a.variable = from_id JOIN {_NODES} b ON b.variable = to_id
        WHERE type = 'KNOWS' AND list_contains(a.labels, 'Person') AND list_contains(b.labels, 'Person') AND rank_text = 'rank:"preferred"'""",
    ),
    "tsv_two_hops": (
        _tsv_two_hops,
        f"""SELECT a.variable AS a, b.variable AS b, c.variable AS c FROM edges_tsv e JOIN {_NODES} a ON a.variable = e.from_id JOIN {_NODES} b ON b.variable = e.to_id
        JOIN edges_tsv f ON f.from_id = b.variable JOIN {_NODES} c ON c.variable = f.to_id
        WHERE e.type = 'KNOWS' AND f.type = 'LIKES' AND list_contains(a.labels, 'Person') AND list_contains(b.labels, 'Q5') AND (list_contains(c.labels, 'Forum') OR list_contains(c.labels, 'Message'))""",
    ),
    **{k: (_social(_pattern_of(*q)), _social_sql(q[0], q[1], q[2] or "true")) for k, q in _BENCHMARK.items()},
    "closed_wedges": (_closed("auto"), _CLOSED_SQL),
    "closed_wedges_multiway": (_closed("multiway"), _CLOSED_SQL),
    "dict_build": (_dictionary(lambda d: d), f"SELECT * FROM {_DICT}"),
    "dict_locate": (_dictionary(lambda d: dictionary.locate(d, "P77")), f"SELECT * FROM {_DICT} WHERE id = 'P77'"),
    "dict_extract": (_dictionary(lambda d: dictionary.extract(d, 12)), f"SELECT * FROM {_DICT} WHERE node_id = 12"),
    "dict_prefix": (_dictionary(lambda d: dictionary.with_prefix(d, "P1")), f"SELECT * FROM {_DICT} WHERE id LIKE 'P1%'"),
    "dict_substr": (_dictionary(lambda d: dictionary.with_substring(d, "22")), f"SELECT * FROM {_DICT} WHERE id LIKE '%22%'"),
    "dict_rank": (_dictionary(lambda d: dictionary.between_ranks(d, 5, 9)), f"SELECT * FROM {_DICT} WHERE node_id BETWEEN 5 AND 9"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**PATTERNS, **{k: f for k, (f, _) in OTHERS.items()}}
ORACLE: dict[str, str] = {**{k: q.sql for k, q in PATTERNS.items()}, **{k: sql for k, (_, sql) in OTHERS.items()}}
