"""A nested-loop evaluator of patterns over small graphs: what the engine's results are held against."""

from itertools import product

from graphloom.functions.ordinal import ordinal_of
from graphloom.plans.ast import And, Compare, Literal, NullTest, Or, Prop, Var, holds


def value_of(text, other_is_text=False):
    """A stored property text as a Python value of (kind, value)."""
    if text is None:
        return None
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return ("string", text[1:-1])
    if (at := ordinal_of(text)) is not None:
        return ("date", at)
    try:
        return ("number", float(text))
    except ValueError:
        return ("string", text)


def evaluate(query, nodes, edges, distinct=False):
    """nodes: id -> (labels, props); edges: list of (id, src, type, dst, props).  Returns a list of tuples."""
    node_vars, edge_vars = query.node_variables(), query.edge_variables()
    names = query.variables()
    out = []
    for picked in product(sorted(nodes), repeat=len(node_vars)):
        binding = dict(zip(node_vars, picked))
        for chosen in product(edges, repeat=len(edge_vars)):
            own = {**binding, **dict(zip(edge_vars, chosen))}
            if distinct and len({e[0] for e in chosen}) < len(chosen):
                continue
            if all(_fits(t, own, nodes, edges) for t in query.triples) and _true(query.where, own, nodes):
                out.append(tuple(own[v] if v in binding else own[v][0] for v in names))
    return sorted(out, key=repr)


def _fits(t, own, nodes, edges):
    def end_ok(end, node):
        if end.var and own[end.var] != node:
            return False
        if end.const and end.const != node:
            return False
        return holds(end.labels, set(nodes[node][0]))

    candidates = [own[t.edge.var]] if t.edge.var else edges
    return any(holds(t.edge.labels, {e[2]}) and end_ok(t.src, e[1]) and end_ok(t.dst, e[3]) for e in candidates)


def _true(c, own, nodes):
    if c is None:
        return True
    if isinstance(c, And):
        return all(_true(i, own, nodes) for i in c.items)
    if isinstance(c, Or):
        return any(_true(i, own, nodes) for i in c.items)

    def get(x):
        if isinstance(x, Literal):
            if x.kind == "datetime":
                return ("date", ordinal_of(x.value))
            return ("string", x.value) if x.kind == "string" else ("number", float(x.value))
        if isinstance(x, Var):
            return ("id", own[x.name] if isinstance(own[x.name], str) else own[x.name][0])
        if isinstance(x, Prop):
            holder = own[x.var]
            props = nodes[holder][1] if isinstance(holder, str) else holder[4]
            return value_of(props.get(x.key))
        return ("id", x.text)

    if isinstance(c, NullTest):
        return (get(c.operand) is not None) == c.negated
    assert isinstance(c, Compare)
    a, b = get(c.left), get(c.right)
    if a is None or b is None or (a[0] != b[0] and {a[0], b[0]} != {"id", "string"}):
        return False
    a, b = a[1], b[1]
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
