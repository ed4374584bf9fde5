import random

import pytest

from graphloom.errors import GraphQueryError, QueryTimeout
from graphloom.plans.binder import with_distinct_edges
from graphloom.plans.parser import parse
from graphloom.plans.planner import match, within
from graphloom.sources.tsv import graph_from_frames
from tests.brute import evaluate

NODES = "id string, labels array<string>, props map<string,string>"
EDGES = "edge_id long, src string, label string, dst string, props map<string,string>"


def small_graph(seed, n=7, m=16):
    r = random.Random(seed)
    nodes = {
        f"n{i}": (
            r.sample(["A", "B", "C"], r.randint(0, 2)),
            {k: v for k, v in (("x", str(r.randint(-3, 3))), ("y", f"{r.randint(0, 4)}.5"), ("s", f'"{r.choice("abc")}b"'), ("t", f"+{r.randint(1990, 1993)}-0{r.randint(0, 2)}-01T00:00:00Z")) if r.random() < 0.7},
        )
        for i in range(n)
    }
    edges = [(i + 1, f"n{r.randrange(n)}", r.choice("TUV"), f"n{r.randrange(n)}", {k: v for k, v in (("w", str(r.randint(0, 3))), ("t", f"{r.randint(1990, 1993)}-01-01T00:00:00Z")) if r.random() < 0.7}) for i in range(m)]
    return nodes, edges


def frames(spark, nodes, edges):
    return spark.createDataFrame([(k, *v) for k, v in nodes.items()], NODES), spark.createDataFrame(edges, EDGES)


KINDS = {"node_props": {"x": "long", "y": "double", "s": "string", "t": "ordinal"}, "edge_props": {"w": "long", "t": "datetime"}}


@pytest.fixture(scope="module")
def graphs(spark):
    out = []
    for seed in (1, 2):
        nodes, edges = small_graph(seed)
        n, e = frames(spark, nodes, edges)
        out.append((nodes, edges, graph_from_frames(n, e, merge=False, **KINDS)))
    return out


PATTERNS = [
    "(?a:A)-[?e:T]->(?b)",
    "(?a)-[?e]->(?b:(A OR NOT B))",
    "(n1)-[?e]->(?b)",
    "(?a)-[?e:(T OR U)]->(n2)",
    "(n1)-[?e:T]->(n2), (?a)-[?f:U]->(?b)",
    "(?a)-[?e:T]->(?b), (?b)-[?f:U]->(?c)",
    "(?a)-[?e]->(?b), (?b)-[?f]->(?c), (?c)-[?g]->(?a)",
    "(?a)-[?e:T]->(?b), (?a)-[?f:T]->(?b)",
    "(?a:A)-[?e:T]->(?b), (?c:B)-[?f:V]->(?d)",
    "(?a)-[:T]->(?b)",
    "(?a)-[:(T OR U)]->(?b), (?b)-[?f]->(?a)",
    "(?a)-[:T]->(:A)",
    "(?a)-[]->(), (?a)-[?e:T]->(?b)",
    "(:B)-[?e:T]->(?b)",
    "(?a)-[?e:(T AND U)]->(?b)",
    "(?a)-[?e]->(?b), (?c)-[?e]->(?d)",
    "(?a)-[?e]->(?b) WHERE (?a.x > 0)",
    "(?a)-[?e]->(?b) WHERE (1 <= ?b.x) AND (?b.x <= 2)",
    "(?a)-[?e]->(?b) WHERE (?a.x != 1)",
    "(?a)-[?e]->(?b) WHERE (?a.y >= 2)",
    "(?a)-[?e]->(?b) WHERE (?a.s < \"bb\") AND (?b.s = 'ab')",
    "(?a)-[?e]->(?b) WHERE (?a.t >= 1991-00-00T00:00:00Z) AND (?e.t < 1993-01-01T00:00:00Z)",
    "(?a)-[?e]->(?b) WHERE (?a.x IS NULL) OR (?e.w IS NOT NULL AND ?b.y > 1.0)",
    "(?a)-[?e]->(?b) WHERE (?a.x = ?b.x)",
    "(?a)-[?e]->(?b) WHERE (?a.x < ?a.y)",
    "(?a)-[?e]->(?b) WHERE (?e.w > ?b.x)",
    "(?a)-[?e]->(?b) WHERE (?e.t <= ?b.t)",
    "(?a)-[?e]->(?b), (?b)-[?f]->(?c) WHERE (?a != ?c) AND (?e.w <= ?f.w)",
    "(?a)-[?e]->(?b), (?b)-[?f]->(?c) WHERE (?a = ?c)",
    "(?a)-[?e]->(?b), (?a)-[?f]->(?c) WHERE (?b < ?c) AND (?e != ?f)",
    "(?a)-[?e]->(?b) WHERE (?a = n3) OR (?b >= \"n4\")",
    "(?a)-[?e]->(?b) WHERE ((?a.x > 0) OR (?b.x > 0)) AND ((?e.w = 1) OR (?a != ?b))",
    "(?a)-[?e]->(?b) WHERE (?a.s = 5)",
    "(?a)-[?e:T]->(?b), (?c)-[?f:U]->(?d) WHERE (?a.x = ?d.x) AND (?a != ?d)",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_against_nested_loops(graphs, pattern):
    for i, (nodes, edges, graph) in enumerate(graphs):
        if i and len(parse(pattern).triples) > 2:
            continue  # the nested loops over three edges are slow; one graph is enough there
        tree = parse(pattern)
        expected = evaluate(tree, nodes, edges)
        rows = sorted((tuple(r) for r in match(graph, pattern).collect()), key=repr)
        assert rows == expected


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if "WHERE" in p][::3] + [PATTERNS[8]])
def test_modes_and_edge_semantics_agree(graphs, pattern):
    nodes, edges, graph = graphs[0]
    tree = parse(pattern)
    expected = evaluate(tree, nodes, edges)
    for mode in ("prefilter", "postfilter"):
        assert sorted((tuple(r) for r in match(graph, pattern, mode=mode).collect()), key=repr) == expected
    distinct = evaluate(tree, nodes, edges, distinct=True)
    assert sorted((tuple(r) for r in match(graph, pattern, edge_semantics="distinct").collect()), key=repr) == distinct
    rewritten = with_distinct_edges(tree)
    assert sorted((tuple(r) for r in match(graph, rewritten).collect()), key=repr) == distinct


@pytest.mark.parametrize(
    "pattern",
    [
        "(?a)-[?e]->(?b), (?b)-[?f]->(?c), (?c)-[:T]->(?a)",
        "(?a:A)-[?e]->(?b), (?b)-[?f]->(?c), (?c)-[]->(?a) WHERE (?e.w <= ?f.w) AND ((?a.x > 0) OR (?b.y > 1.0)) AND (?a < ?c)",
        "(?a)-[:T]->(?p), (?b)-[:T]->(?p), (?a)-[:U]->(?q), (?b)-[:U]->(?q), (?q)-[?g:V]->(?z) WHERE (?a != ?b)",
        "(?a)-[?e:T]->(?b), (?a)-[?f]->(?b), (?b)-[:(U OR V)]->(?a)",
    ],
)
def test_multiway_strategy(graphs, pattern):
    for nodes, edges, graph in graphs:
        rows = sorted((tuple(r) for r in match(graph, pattern, strategy="multiway").collect()), key=repr)
        assert rows == evaluate(parse(pattern), nodes, edges)


def test_strategies_are_refused_or_picked_by_estimate(graphs, monkeypatch):
    from graphloom.plans import planner

    graph = graphs[0][2]
    cycle, chain = "(?a)-[?e]->(?b), (?b)-[?f]->(?c), (?c)-[?g]->(?a) RETURN ?a, ?b, ?c", "(?a)-[?e]->(?b), (?b)-[?f]->(?c)"
    with pytest.raises(GraphQueryError):
        match(graph, chain, strategy="multiway")
    in_cells = lambda text: "FlatMapGroupsInArrow" in match(graph, text)._jdf.queryExecution().toString()
    assert not in_cells(cycle) and not in_cells(chain)
    monkeypatch.setattr(planner, "MULTIWAY_FACTOR", 0)
    assert in_cells(cycle) and not in_cells(chain)
    assert sorted(map(tuple, match(graph, cycle).collect())) == sorted(map(tuple, match(graph, cycle, strategy="pairwise").collect()))


def test_random_patterns(graphs):
    r = random.Random(5)
    nodes, edges, graph = graphs[1]
    for _ in range(12):
        names = ["a", "b", "c"]
        triples = []
        for i in range(r.randint(1, 2)):
            s, d = r.sample(names, 2)
            label = r.choice(["", ":A", ":(A OR B)", ":(NOT C)"])
            triples.append(f"(?{s}{label})-[?e{i}{r.choice(['', ':T', ':(U OR V)'])}]->(?{d})")
        used = sorted({x for t in triples for x in names if f"?{x}" in t})
        conditions = [r.choice([f"(?{r.choice(used)}.x {op} {r.randint(-2, 2)})", f"(?e0.w {op} ?{r.choice(used)}.x)", f"(?{r.choice(used)}.s {op} \"bb\")"]) for op in r.sample(["=", "!=", "<", "<=", ">", ">="], r.randint(0, 2))]
        pattern = ", ".join(triples) + (" WHERE " + r.choice([" AND ", " OR "]).join(conditions) if conditions else "")
        assert sorted((tuple(x) for x in match(graph, pattern).collect()), key=repr) == evaluate(parse(pattern), nodes, edges), pattern


@pytest.mark.parametrize(
    "pattern",
    [
        "(?a:Nope)-[?e]->(?b)", "(?a)-[?e:NOPE]->(?b)", "(?a)-[?e]->(nope)", "(?a)-[?e]->(?b) WHERE (?a.nope = 1)", "(?a)-[?e]->(?b) WHERE (?c.x = 1)", "(?a)-[?e]->(?b) WHERE (?e.x = 1)",
        "(?a)-[?e]->(?a)", "(?a)-[?a]->(?b)", "(?a)-[?e]->(?b) WHERE (?a = ?e)", "(?a)-[?e]->(?b) WHERE (1 = 2)", "(?a)-[?e]->(?b) WHERE (?a = nope)", "(?a)-[?e]->(?b) WHERE (?a = ?b.x)",
        "(n1)-[:T]->(n2)", "(?a)-[?e]->(?b) WHERE (?e1 != e3)", "(?a)-[?e]->(?b) WHERE (?a IS NULL)", "(?a)-[?e]->(?b) RETURN ?z", "(?a)-[?e]->(?b) WHERE (?a > 0)",
    ],
)
def test_what_may_not_be_said(graphs, pattern):
    with pytest.raises(GraphQueryError):
        match(graphs[0][2], pattern)


def test_output_columns_limit_and_projection(graphs):
    graph = graphs[0][2]
    assert match(graph, "(?b)-[?e]->(?a)").columns == ["b", "e", "a"]
    df = match(graph, "(?a)-[?e:T]->(?b) RETURN ?b.x AS x, ?a, ?e.w", limit=2)
    assert df.columns == ["x", "a", "e.w"] and df.count() <= 2
    assert match(graph, "(?a)-[?A]->(?b)").columns == ["a", "A_2", "b"]
    # dates that no timestamp holds come out as text again
    shown = {r[0] for r in match(graph, "(?a)-[?e]->(?b) RETURN ?a.t AS t").collect()}
    assert all(t is None or t.startswith("+199") for t in shown)


def test_empty_graph(spark):
    graph = graph_from_frames(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), {}, {})
    assert match(graph, "(?a)-[?e]->(?b)").count() == 0


def test_edges_with_unknown_ends_and_repeated_nodes(spark):
    nodes = spark.createDataFrame([("a", ["X"], {"k": "1"}), ("a", ["Y"], {"k": "2"}), ("b", None, None), (None, ["X"], {})], NODES).filter("id IS NOT NULL")
    edges = spark.createDataFrame([(1, "a", "T", "b", {}), (2, "a", "T", "gone", {}), (3, None, "T", "b", {}), (4, "a", "T", "b", None)], EDGES)
    graph = graph_from_frames(nodes, edges, {"k": "long"}, {})
    assert sorted(r[0] for r in match(graph, "(?x:(X AND Y))-[?e:T]->(?y)  RETURN ?e").collect()) == [1, 4]


def test_time_limit(spark):
    slow = spark.range(0, 1 << 40, 1, 4).selectExpr("max(id % 7) AS x")
    with pytest.raises(QueryTimeout):
        within(slow, 1.0, lambda d: d.collect())
    assert within(spark.range(5), 60.0) == 5
