"""Query trees back to text: the pattern language itself, the MQL dialect and Cypher."""

from __future__ import annotations

from graphloom.errors import GraphQueryError
from graphloom.plans.ast import And, Compare, Label, LabelAnd, LabelNot, LabelOr, Literal, Name, NullTest, Or, Prop, Query, Var


def _quoted(text: str) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


def _label_text(expr, top: bool = True) -> str:
    if isinstance(expr, Label):
        return expr.name
    if isinstance(expr, LabelNot):
        text = f"NOT {_label_text(expr.item, False)}"
        return f"({text})" if top else text
    word = " AND " if isinstance(expr, LabelAnd) else " OR "
    return "(" + word.join(_label_text(i, False) for i in expr.items) + ")"


def _condition(c, operand, op_names: dict[str, str]) -> str:
    if isinstance(c, (And, Or)):
        word = " AND " if isinstance(c, And) else " OR "
        inner = [_condition(i, operand, op_names) for i in c.items]
        return "(" + word.join(inner) + ")" if isinstance(c, Or) else word.join(inner)
    if isinstance(c, NullTest):
        return f"({operand(c.operand)} IS {'NOT ' if c.negated else ''}NULL)"
    return f"({operand(c.left)} {op_names.get(c.op, c.op)} {operand(c.right)})"


def _literal(x, date: str) -> str:
    if isinstance(x, Literal):
        if x.kind == "datetime":
            return date.format(x.value)
        return _quoted(x.value) if x.kind == "string" else repr(x.value)
    if isinstance(x, Name):
        return x.text
    return f"?{x.name}" if isinstance(x, Var) else f"?{x.var}.{x.key}"


def _edge_name(e) -> str:
    return f"?{e.var}" if e.var else "" if e.const is None else str(e.const)


def to_pattern(q: Query) -> str:
    """The query in the pattern language; parses to the same tree."""

    def node(n) -> str:
        return f"({f'?{n.var}' if n.var else n.const or ''}{':' + _label_text(n.labels) if n.labels else ''})"

    text = ", ".join(f"{node(t.src)}-[{_edge_name(t.edge)}{':' + _label_text(t.edge.labels) if t.edge.labels else ''}]->{node(t.dst)}" for t in q.triples)
    if q.where is not None:
        text += " WHERE " + _condition(q.where, lambda x: _literal(x, "ZONED_DATETIME('{}')"), {})
    if q.returns:
        text += " RETURN " + ", ".join(f"{_literal(r.operand, '')}{f' AS {r.alias}' if '.' not in r.alias and not (isinstance(r.operand, Var) and r.operand.name == r.alias) else ''}" for r in q.returns)
    return text + (f" LIMIT {q.limit}" if q.limit is not None else "")


def to_mql(q: Query) -> str:
    """MQL: labels in a row, ``==``, ``dateTimeStamp``.  Label OR and NOT cannot be said there and raise."""

    def labels(expr) -> str:
        if expr is None:
            return ""
        items = expr.items if isinstance(expr, LabelAnd) else (expr,)
        if not all(isinstance(i, Label) for i in items):
            raise GraphQueryError("MQL has no OR or NOT over labels")
        return "".join(f" :{i.name}" for i in items)

    def node(n) -> str:
        return f"({f'?{n.var}' if n.var else n.const or ''}{labels(n.labels)})"

    text = "MATCH " + ", ".join(f"{node(t.src)}-[{_edge_name(t.edge)}{labels(t.edge.labels)}]->{node(t.dst)}" for t in q.triples)
    if q.where is not None:
        text += " WHERE " + _condition(q.where, lambda x: _literal(x, 'dateTimeStamp("{}")'), {"=": "=="})
    names = [_literal(r.operand, "") for r in q.returns] if q.returns else [f"?{v}" for v in q.variables()]
    return text + " RETURN " + ", ".join(names) + (f" LIMIT {q.limit}" if q.limit is not None else "")


def to_cypher(q: Query) -> str:
    """Cypher over nodes that carry the label ``Entity`` and their id in ``qid``."""
    nodes, count, seen, constants = set(q.node_variables()), 0, set(), {}

    def labels(expr) -> tuple[str, object | None]:
        if expr is None:
            return "", None
        items = expr.items if isinstance(expr, LabelAnd) else (expr,)
        if all(isinstance(i, Label) for i in items):
            return "".join(f":{i.name}" for i in items), None
        return "", expr

    def test(name: str, expr) -> str:
        if isinstance(expr, Label):
            return f"{name}:{expr.name}"
        if isinstance(expr, LabelNot):
            return f"NOT ({test(name, expr.item)})"
        return "(" + (" AND " if isinstance(expr, LabelAnd) else " OR ").join(test(name, i) for i in expr.items) + ")"

    extra: list[str] = []

    def node(n) -> str:
        nonlocal count
        if n.const:
            if n.const not in constants:
                count += 1
                constants[n.const] = f"fixed{count}"
            return f"({constants[n.const]}:Entity {{ qid: {_quoted(n.const)}}})"
        plain, rest = labels(n.labels)
        name = n.var or ""
        if rest is not None:
            if not name:
                count += 1
                name = f"anon{count}"
            extra.append(test(name, rest))
        seen.add(name)
        return f"({name}:Entity{plain})"

    def edge_types(expr) -> str | None:
        if isinstance(expr, Label):
            return expr.name
        if isinstance(expr, LabelOr) and all(isinstance(i, Label) for i in expr.items):
            return "|".join(i.name for i in expr.items)
        return None

    def edge(e) -> str:
        nonlocal count
        name = e.var
        types = edge_types(e.labels) if e.labels is not None else None
        if not name and (e.const is not None or (e.labels is not None and types is None)):
            count += 1
            name = f"anon{count}"
        if e.const is not None:
            extra.append(f"id({name}) = {e.const}")
        if e.labels is None:
            return f"[{name or ''}]"
        if types is not None:
            return f"[{name or ''}:{types}]"

        def type_test(expr) -> str:
            if isinstance(expr, Label):
                return f"type({name}) = {_quoted(expr.name)}"
            if isinstance(expr, LabelNot):
                return f"NOT ({type_test(expr.item)})"
            return "(" + (" AND " if isinstance(expr, LabelAnd) else " OR ").join(type_test(i) for i in expr.items) + ")"

        extra.append(type_test(e.labels))
        return f"[{name}]"

    def operand(x) -> str:
        if isinstance(x, Prop):
            return f"{x.var}.{x.key}"
        if isinstance(x, Var):
            return f"{x.name}.qid" if x.name in nodes else f"id({x.name})"
        if isinstance(x, Name):
            return _quoted(x.text)
        return _literal(x, "datetime('{}')")

    def where(c) -> str:
        # the identity of two variables is compared by themselves, not by their ids
        if isinstance(c, (And, Or)):
            word = " AND " if isinstance(c, And) else " OR "
            inner = word.join(where(i) for i in c.items)
            return f"({inner})" if isinstance(c, Or) else inner
        if isinstance(c, Compare) and isinstance(c.left, Var) and isinstance(c.right, Var) and c.op in ("=", "!="):
            return f"({c.left.name} {'<>' if c.op == '!=' else '='} {c.right.name})"
        return _condition(c, operand, {"!=": "<>"})

    text = "MATCH " + ", ".join(f"{node(t.src)}-{edge(t.edge)}->{node(t.dst)}" for t in q.triples)
    conditions = ([where(q.where)] if q.where is not None else []) + [f"({x})" for x in extra]
    if conditions:
        text += " WHERE " + " AND ".join(conditions)
    items = [r.operand for r in q.returns] if q.returns else [Var(v) for v in q.variables()]
    return text + " RETURN " + ", ".join(operand(i) for i in items) + (f" LIMIT {q.limit}" if q.limit is not None else "")
