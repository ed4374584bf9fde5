import json

import pytest

from graphloom.errors import GraphQueryError
from graphloom.functions import dictionary
from graphloom.functions.ordinal import as_timestamp, ordinal_of, ordinal_of_text, text_of_ordinal
from graphloom.plans.planner import match
from graphloom.sources import cypher, export, lsqb, store, tsv, wikidata

NODE_LINES = 'a\t:Person:Staff\tname:"Ann"\tborn:1960\tat:+1964-09-02T00:00:00Z\nb\t:Person\tname:"Bob, \\"B\\""\tscore:3.5\tborn:1970\n c \t\tborn:1:2\tborn:1980\t:x\tempty\nd\t:Place\tat:-0044-03-15T00:00:00Z\nlone\t:Place\n'
EDGE_LINES = 'a\tKNOWS\tb\tsince:2000\trank:"n"\na\tKNOWS\tb\tsince:2001\nb\tLIVES\td\nc\tKNOWS\tc\na\tKNOWS\tgone\ngone\tKNOWS\ta\nbad line\n'


@pytest.fixture()
def prefix(tmp_path):
    (tmp_path / "g-nodes.tsv").write_text(NODE_LINES)
    (tmp_path / "g-edges.tsv").write_text(EDGE_LINES)
    return str(tmp_path / "g")


def test_tsv_lines(spark, prefix):
    nodes, edges = tsv.read_tsv(spark, prefix)
    got = {r["id"]: (r["labels"], r["props"]) for r in nodes.collect()}
    assert got["a"] == (["Person", "Staff"], {"name": '"Ann"', "born": "1960", "at": "+1964-09-02T00:00:00Z"})
    assert got["c"] == ([], {"born": "1980"})
    assert edges.count() == 6
    line = spark.createDataFrame([("x\t:Q101: 0A0 :1\t1k:1v1",)], "value string")
    assert tuple(tsv.parse_node_lines(line).head()) == ("x", ["Q101", "0A0", "1"], {"1k": "1v1"})


def test_load_clean_and_write(spark, prefix):
    nodes, edges = tsv.read_tsv(spark, prefix)
    assert tsv.with_known_ends(nodes, edges).count() == 4
    kept_nodes, kept_edges = tsv.clean(nodes, edges)
    assert sorted(r["src"] for r in kept_edges.collect()) == ["a", "a", "b", "c", "gone"]
    assert sorted(r["id"] for r in kept_nodes.collect()) == ["a", "b", "c", "d"]
    graph = tsv.load_tsv(spark, prefix)
    assert graph.node_props == {"name": "string", "born": "long", "score": "double", "at": "ordinal"}
    assert graph.node_labels == {"Person", "Staff", "Place"} and graph.edge_types == {"KNOWS", "LIVES"}
    assert [tuple(r) for r in match(graph, "(?x:Person)-[?e:KNOWS]->(?y) WHERE (?e.since = 2001) AND (?x.name = \"Ann\") RETURN ?x, ?y").collect()] == [("a", "b")]
    assert match(graph, "(?x)-[?e:KNOWS]->(?y) WHERE (?x.at < 1900-01-01T00:00:00Z)").count() == 0
    assert match(graph, "(?x)-[?e]->(?y) WHERE (?y.at < 0001-01-01T00:00:00Z)").count() == 1
    tsv.write_tsv(nodes, edges, prefix + "2")
    again, _ = tsv.read_tsv(spark, prefix + "2")
    plain = lambda df: sorted((r["id"], r["labels"], sorted(r["props"].items())) for r in df.collect())
    assert plain(again) == plain(nodes)


def test_stored_graph_has_ranks(spark, prefix, tmp_path):
    nodes, edges = tsv.read_tsv(spark, prefix)
    catalog = store.build(nodes, edges, str(tmp_path / "s"))
    assert catalog["types"] == {"KNOWS": 3, "LIVES": 1} and catalog["nodes"] == 5
    assert catalog["squares"] == {"src": {"KNOWS": 5.0, "LIVES": 1.0}, "dst": {"KNOWS": 5.0, "LIVES": 1.0}, "both": {"KNOWS": 1.0, "LIVES": 0.0}}
    graph = store.load(spark, str(tmp_path / "s"))
    rows = sorted(tuple(r) for r in match(graph, "(?x)-[?e]->(?y) RETURN ?e, ?x, ?y").collect())
    assert rows == [(1, "a", "b"), (2, "a", "b"), (3, "c", "c"), (4, "b", "d")]
    assert sorted(r[0] for r in match(graph, "(?x)-[?e]->(?y) WHERE (?x <= 2) AND (?e > 1) RETURN ?e").collect()) == [2, 4]
    assert [tuple(r) for r in match(graph, "(?x)-[3]->(?y)").collect()] == [("c", "c")] and match(graph, "(?x)-[3:LIVES]->(?y)").count() == 0
    with pytest.raises(GraphQueryError):
        match(graph, "(?x)-[9]->(?y)")
    pushed = match(graph, "(?x)-[?e:KNOWS]->(?y) WHERE (?e.since > 2000) AND (?x.born < 1970) RETURN ?e")
    assert [r[0] for r in pushed.collect()] == [2]
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p" in plan and "LessThan(p" in plan
    plan = match(graph, "(?x)-[?e:LIVES]->(?y)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "LIVES" in plan


def test_ordinals(spark):
    texts = ["+1964-09-02T01:02:03Z", "-0044-03-15T00:00:00Z", "2000-00-00T00:00:00Z", "1999-12-31T23:59:59Z", "nonsense", None, "2000-13-01T00:00:00Z"]
    numbers = [t and ordinal_of(t) for t in texts]
    assert numbers[4] is None and numbers[6] is None and numbers[1] < numbers[0] < numbers[3] < numbers[2]
    assert as_timestamp("2000-00-00T00:00:00Z") is None and as_timestamp("2000-01-02T03:04:05Z").hour == 3
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ordinal_of_text(F.col("t")).alias("n")).withColumn("back", text_of_ordinal(F.col("n")))
    rows = df.collect()
    assert [r["n"] for r in rows] == numbers
    assert [r["back"] for r in rows][:3] == ["+1964-09-02T01:02:03Z", "-0044-03-15T00:00:00Z", "+2000-00-00T00:00:00Z"]


MOVIES = """// a comment
CREATE (Heat:Movie:Film {title:"Heat", released:1995, tags:["crime", 'noir']});
CREATE (Al:Person {name:'Al "A" P.', born:1940})
CREATE
(Al)-[:ACTED_IN {role:"V\\"H"}]->(Heat),
(Val:Person {name:"Val"})-[:ACTED_IN]->(Heat);
CREATE (Al)-[:KNOWS {since: datetime('1994-01-01T00:00:00Z')}]->(Val)-[:KNOWS]->(Al);
"""


def test_cypher(spark, tmp_path):
    (tmp_path / "m.cypher").write_text(MOVIES)
    nodes, edges = cypher.read_cypher(spark, str(tmp_path / "m.cypher"), statements_span_lines=True)
    got = {r["id"]: (r["labels"], r["props"]) for r in nodes.collect()}
    assert got["Heat"] == (["Movie", "Film"], {"title": '"Heat"', "released": "1995", "tags": '"crime"'})
    assert got["Al"][1]["name"] == '"Al "A" P."' and set(got) == {"Heat", "Al", "Val"}
    assert sorted((r["src"], r["label"], r["dst"]) for r in edges.collect()) == [("Al", "ACTED_IN", "Heat"), ("Al", "KNOWS", "Val"), ("Val", "ACTED_IN", "Heat"), ("Val", "KNOWS", "Al")]
    graph = tsv.graph_from_frames(nodes, edges)
    rows = match(graph, "(?p:Person)-[:ACTED_IN]->(?m:Movie) WHERE (?p.born IS NULL) RETURN ?p, ?m.title AS t").collect()
    assert [tuple(r) for r in rows] == [("Val", "Heat")]
    (tmp_path / "l.cypher").write_text("CREATE (a:X);\n\nCREATE (a)-[:T]->(b)\n")
    assert cypher.read_cypher(spark, str(tmp_path / "l.cypher"))[1].count() == 1
    for bad in ("MERGE (a)", "CREATE (a", "CREATE (a)-[:T]->", "CREATE (a)<-[:T]-(b)"):
        with pytest.raises(GraphQueryError):
            cypher.parse_create(bad)


def test_lsqb(spark, tmp_path):
    for kind in lsqb.NODE_FILES:
        (tmp_path / f"{kind}.csv").write_text("id\n1\n2\n")
    for files in lsqb.EDGE_FILES.values():
        for name in files:
            (tmp_path / f"{name}.csv").write_text("a|b\n1|2\n")
    nodes, edges = lsqb.read_lsqb(spark, str(tmp_path))
    assert nodes.count() == 22 and edges.count() == 25
    graph = tsv.graph_from_frames(nodes, edges)
    assert match(graph, "(?m:Message)-[?e:HAS_TAG]->(?t:Tag)").count() == 2
    assert match(graph, "(?m:(Message AND Post))-[?e:HAS_TAG]->(?t:Tag) RETURN ?m").head()[0] == "Post_1"


def snak(value, kind="x"):
    return {"datavalue": {"value": value}, "datatype": kind}


def test_wikidata(spark, tmp_path):
    item = lambda q: {"mainsnak": snak({"entity-type": "item", "id": q}, "wikibase-item"), "rank": "normal"}
    entities = [
        {
            "id": "Q1",
            "claims": {
                "P31": [item("Q5"), item("Q6")],
                "P10": [{**item("Q2"), "qualifiers": {"P580": [snak({"time": "+2001-00-00T00:00:00Z"})], "P99": [snak({"amount": "+7"})], "P98": [snak("text")], "P97": [snak({"latitude": 1.5, "longitude": -2.25})]}}, item("L9")],
                "P569": [{"mainsnak": snak({"time": "+1950-02-31T00:00:00Z"})}, {"mainsnak": snak({"time": "+1950-00-00T00:00:00Z"})}, {"mainsnak": snak({"time": "+1960-01-01T00:00:00Z"})}],
                "P1082": [{"mainsnak": snak({"amount": "+1.5"})}, {"mainsnak": snak({"amount": "-42"})}],
                "P625": [{"mainsnak": snak({"latitude": 48.5, "longitude": 2.25})}],
                "P2": [{"mainsnak": snak('say "hi"')}],
                "P3": [{"mainsnak": {"snaktype": "novalue"}}],
            },
        },
        {"id": "Q2", "claims": {"P569": [{"mainsnak": snak({"time": "+13800000000-00-00T00:00:00Z"})}]}},
        {"claims": {}},
    ]
    path = tmp_path / "dump.json"
    path.write_text("[\n" + ",\n".join(json.dumps(e) for e in entities) + "\n]\n")
    nodes, edges = wikidata.read_wikidata(spark, str(path))
    got = {r["id"]: (r["labels"], r["props"]) for r in nodes.collect()}
    assert got["Q1"] == (["Q5", "Q6"], {"P569": "+1950-01-01T00:00:00Z", "P1082": "-42", "P625lat": "48.5", "P625lon": "2.25", "P2": '"say \\"hi\\""'})
    assert got["Q2"] == ([], {})
    (edge,) = edges.collect()
    assert (edge["src"], edge["label"], edge["dst"]) == ("Q1", "P10", "Q2")
    assert edge["props"] == {"P580": "+2001-01-01T00:00:00Z", "P99": "7", "P97lat": "1.5", "P97lon": "-2.25", "rank": '"normal"'}
    one = tmp_path / "one.json"
    one.write_text(json.dumps(entities))
    assert wikidata.read_entities(spark, str(one), one_document=True).count() == 2


def test_exports(spark, prefix, tmp_path):
    nodes, edges = tsv.read_tsv(spark, prefix)
    edges = tsv.with_known_ends(nodes, edges)
    lines = {r[0] for r in export.nodes_to_cypher(nodes).collect()}
    assert "CREATE (a:Person:Staff {qid: \"a\", at: datetime('+1964-09-02T00:00:00Z'), born: 1960, name: \"Ann\"});" in lines
    assert 'MATCH (a {qid:"a"}), (b {qid:"b"}) CREATE (a)-[:KNOWS {rank: "n", since: 2000}]->(b);' in {r[0].replace("qid: ", "qid:") for r in export.edges_to_cypher(edges).collect()}
    assert 'a :Person :Staff at:dateTimeStamp("1964-09-02T00:00:00Z") born:1960 name:"Ann"' in {r[0] for r in export.nodes_to_mql(nodes).collect()}
    assert 'a->b :KNOWS rank:"n" since:2000' in {r[0] for r in export.edges_to_mql(edges).collect()}
    table, links = export.to_bulk_tables(nodes, edges)
    assert table.columns[:2] == ["id:ID", ":LABEL"] and {"born:long", "score:double", "name:string"} <= set(table.columns) and links.count() == 4
    compact, _ = export.to_bulk_tables(nodes, edges, compact=True)
    assert compact.columns[-1] == "properties:string" and "name:string" not in compact.columns
    batches = [r[0] for r in export.to_unwind_batches(edges.coalesce(1), 2).collect()]
    assert len(batches) == 3 and all(b.startswith("UNWIND [{a: ") for b in batches)
    export.write_table(table, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).count() == 5
    export.write_text(export.nodes_to_cypher(nodes), str(tmp_path / "txt"))
    fixed = spark.createDataFrame([("x", ["A b"], {"at": "+2000-00-00T00:00:00Z"})], "id string, labels array<string>, props map<string,string>")
    assert export.nodes_to_cypher(fixed).head()[0] == "CREATE (x:`A b` {qid: \"x\", at: datetime('+2000-01-01T00:00:00Z')});"


def test_dictionary(spark):
    d = dictionary.build(spark.createDataFrame([("b",), ("a",), ("ab",), (None,), ("a",)], "n string"), "n").cache()
    assert [(r["id"], r["node_id"]) for r in dictionary.entries(d).collect()] == [("a", 1), ("ab", 2), ("b", 3)]
    assert dictionary.locate(d, "ab").head()["node_id"] == 2 and dictionary.extract(d, 3).head()["id"] == "b"
    assert dictionary.with_prefix(d, "a").count() == 2 and dictionary.with_substring(d, "b").count() == 2
    assert dictionary.between_ranks(d, 2, 3).count() == 2 and dictionary.size(d) == 3
    assert dictionary.contains(d, "b") and not dictionary.contains(d, "c") and dictionary.locate(d, "zz").count() == 0
