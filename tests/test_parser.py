import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.errors import GraphQueryError
from graphloom.plans.ast import And, Compare, Label, LabelAnd, LabelNot, LabelOr, Literal, Name, NullTest, Or, Prop, Var
from graphloom.plans.emit import to_cypher, to_mql, to_pattern
from graphloom.plans.parser import parse, read_queries


def test_triples_and_labels():
    q = parse("(?a:Person)-[?e:KNOWS]->(?b), (?b)-[:LIKES]->(Poet:(Post OR NOT Tag AND Message))")
    assert q.variables() == ["a", "e", "b"]
    assert q.triples[0].src.labels == Label("Person")
    assert q.triples[1].edge.var is None and q.triples[1].dst.const == "Poet"
    assert q.triples[1].dst.labels == LabelOr((Label("Post"), LabelAnd((LabelNot(Label("Tag")), Label("Message")))))


def test_label_rows_and_ampersand_mean_and():
    both = LabelAnd((Label("Fruit"), Label("Ripe")))
    assert parse("(?v :Fruit :Ripe)-[?e]->(basket_1)").triples[0].src.labels == both
    assert parse("(?v:Fruit&Ripe)-[?e]->(basket_1)").triples[0].src.labels == both


def test_constant_edges():
    q = parse("(?a)-[17]->(?b), (?a)-[0:T]->(?c)")
    assert [t.edge.const for t in q.triples] == [17, 0] and q.variables() == ["a", "b", "c"]
    assert to_pattern(q) == "(?a)-[17]->(?b), (?a)-[0:T]->(?c)" and parse(to_pattern(q)) == q
    assert to_mql(q) == "MATCH (?a)-[17]->(?b), (?a)-[0 :T]->(?c) RETURN ?a, ?b, ?c"
    assert to_cypher(q) == "MATCH (a:Entity)-[anon1]->(b:Entity), (a:Entity)-[anon2:T]->(c:Entity) WHERE (id(anon1) = 17) AND (id(anon2) = 0) RETURN a.qid, b.qid, c.qid"


def test_keywords_are_whole_words():
    assert parse("(?v:(NOTABLE AND ORBIT))-[?e]->(?w)").triples[0].src.labels == LabelAnd((Label("NOTABLE"), Label("ORBIT")))


def test_where_precedence_and_operands():
    q = parse("""(?a)-[?e]->(?b) WHERE (?a.x > 5) AND (?b.y <> "a > b" OR ?e == ?e) OR (?a = tom)""")
    first, second = q.where.items
    assert isinstance(q.where, Or) and isinstance(first, And)
    assert first.items[1] == Or((Compare("!=", Prop("b", "y"), Literal("a > b", "string")), Compare("=", Var("e"), Var("e"))))
    assert second == Compare("=", Var("a"), Name("tom"))


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ("-12", Literal(-12, "long")),
        ("3.", Literal(3.0, "double")),
        ("1e3", Literal(1000.0, "double")),
        ("'it''s'".replace("''", "\\'"), Literal("it's", "string")),
        ("+1964-09-02T00:00:00Z", Literal("+1964-09-02T00:00:00Z", "datetime")),
        ("ZONED_DATETIME('1900-01-01T00:00:00Z')", Literal("1900-01-01T00:00:00Z", "datetime")),
        ('dateTimeStamp("1900-00-00T00:00:00Z")', Literal("1900-00-00T00:00:00Z", "datetime")),
        ('"1900-01-01T00:00:00Z"', Literal("1900-01-01T00:00:00Z", "datetime")),
    ],
)
def test_literals(text, literal):
    assert parse(f"(?a)-[?e]->(?b) WHERE (?a.x = {text})").where.right == literal
    assert parse(f"(?a)-[?e]->(?b) WHERE ({text} = ?a.x)").where.left == literal


def test_null_tests_return_and_limit():
    q = parse("MATCH (?a)-[?e]->(?b) WHERE ?a.x IS NOT NULL AND (?e.y IS NULL) RETURN ?a, ?e.y AS y, ?b LIMIT 5")
    assert q.where == And((NullTest(Prop("a", "x"), True), NullTest(Prop("e", "y"), False)))
    assert [r.alias for r in q.returns] == ["a", "y", "b"] and q.limit == 5


@pytest.mark.parametrize(
    "text",
    ["", "(?a)", "(?a)<-[?e]-(?b)", "(?a)--(?b)", "(?a)-[?e]->(?b", "(?a)-[e5:T]->(?b)", "(?a)-[?e]->(?b) WHERE", "(?a)-[?e]->(?b) WHERE (?a.x >)", "(?a)-[?e]->(?b) extra", "(?a)-[?e]->(?b) WHERE ?a.x IS 5", "(?a)-[?e]->(?b) RETURN a"],
)
def test_errors(text):
    with pytest.raises(GraphQueryError):
        parse(text)


def test_emitters():
    q = parse("(?v:Poet)-[?e:MET]->(ann) WHERE (?v.born < dateTimeStamp(\"1928-01-01T00:00:00Z\")) AND (?e != ?e) AND (?v.x = 'a\"b')")
    assert to_mql(q) == 'MATCH (?v :Poet)-[?e :MET]->(ann) WHERE (?v.born < dateTimeStamp("1928-01-01T00:00:00Z")) AND (?e != ?e) AND (?v.x == "a\\"b") RETURN ?v, ?e'
    assert to_cypher(q) == """MATCH (v:Entity:Poet)-[e:MET]->(fixed1:Entity { qid: "ann"}) WHERE (v.born < datetime('1928-01-01T00:00:00Z')) AND (e <> e) AND (v.x = "a\\"b") RETURN v.qid, id(e)"""
    assert parse(to_mql(q)).where == q.where
    with pytest.raises(GraphQueryError):
        to_mql(parse("(?a:(X OR Y))-[?e]->(?b)"))
    assert "type(" in to_cypher(parse("(?a:(X OR NOT Y))-[?e:(NOT T)]->(?b)")) and "NOT (a:Y)" in to_cypher(parse("(?a:(X OR NOT Y))-[?e]->(?b)"))


_name = st.from_regex(r"[A-Za-z][A-Za-z0-9_]{0,4}", fullmatch=True).filter(lambda x: x not in ("AND", "OR", "NOT", "IS", "NULL", "WHERE", "RETURN", "LIMIT", "MATCH", "AS"))
_labels = st.recursive(
    _name.map(Label),
    lambda inner: st.one_of(_name.map(lambda n: LabelNot(Label(n))), st.lists(inner, min_size=2, max_size=3).map(lambda x: LabelAnd(tuple(x))), st.lists(inner, min_size=2, max_size=3).map(lambda x: LabelOr(tuple(x)))),
    max_leaves=4,
)
_value = st.one_of(
    st.integers(-(10**9), 10**9).map(lambda x: Literal(x, "long")),
    st.floats(allow_nan=False, allow_infinity=False).map(lambda x: Literal(x, "double")),
    st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=6).map(lambda x: Literal(x, "string")),
)


@given(_labels, _name, _value, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]))
def test_text_form_round_trips(labels, key, value, op):
    from graphloom.plans.ast import Edge, Node, Query, Triple

    q = Query((Triple(Node("a", None, labels), Edge("e", labels), Node("b")),), And((Compare(op, Prop("a", key), value), Or((NullTest(Prop("e", key), True), Compare(op, value, Prop("b", key)))))))
    assert parse(to_pattern(q)) == q or _flat(parse(to_pattern(q))) == _flat(q)


def _flat(q):
    return to_pattern(q)


def test_query_files(tmp_path):
    path = tmp_path / "q.txt"
    path.write_text("  (?a)-[?e]->(?b)  \n\n(?c)-[?f]->(?d)\n")
    assert read_queries(str(path)) == ["(?a)-[?e]->(?b)", "(?c)-[?f]->(?d)"]
