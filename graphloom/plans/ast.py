"""Syntax tree of pattern queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Label:
    name: str


@dataclass(frozen=True)
class LabelNot:
    item: Label | LabelAnd | LabelOr | LabelNot


@dataclass(frozen=True)
class LabelAnd:
    items: tuple


@dataclass(frozen=True)
class LabelOr:
    items: tuple


@dataclass(frozen=True)
class Node:
    """A node pattern: a variable, a constant id, or neither (anonymous)."""

    var: str | None = None
    const: str | None = None
    labels: object | None = None


@dataclass(frozen=True)
class Edge:
    """An edge pattern: a variable, a constant number, or neither (anonymous)."""

    var: str | None = None
    labels: object | None = None
    const: int | None = None


@dataclass(frozen=True)
class Triple:
    src: Node
    edge: Edge
    dst: Node


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    key: str


@dataclass(frozen=True)
class Literal:
    """kind is long, double, string or datetime; a datetime keeps its text."""

    value: object
    kind: str


@dataclass(frozen=True)
class Name:
    """A bare word in a condition: the id of a node."""

    text: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class NullTest:
    operand: object
    negated: bool


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Return:
    operand: object
    alias: str


@dataclass(frozen=True)
class Query:
    triples: tuple[Triple, ...]
    where: object | None = None
    returns: tuple[Return, ...] | None = None
    limit: int | None = None

    def variables(self) -> list[str]:
        """Variables in order of first appearance."""
        seen: dict[str, None] = {}
        for t in self.triples:
            for part in (t.src, t.edge, t.dst):
                if part.var:
                    seen.setdefault(part.var)
        return list(seen)

    def node_variables(self) -> list[str]:
        seen: dict[str, None] = {}
        for t in self.triples:
            for part in (t.src, t.dst):
                if part.var:
                    seen.setdefault(part.var)
        return list(seen)

    def edge_variables(self) -> list[str]:
        return list(dict.fromkeys(t.edge.var for t in self.triples if t.edge.var))


def conjuncts(condition: object | None) -> list:
    """The conditions that must all hold."""
    if condition is None:
        return []
    if isinstance(condition, And):
        return [c for item in condition.items for c in conjuncts(item)]
    return [condition]


def variables_of(condition: object) -> set[str]:
    if isinstance(condition, (And, Or)):
        return set().union(*(variables_of(i) for i in condition.items))
    if isinstance(condition, Compare):
        return variables_of(condition.left) | variables_of(condition.right)
    if isinstance(condition, NullTest):
        return variables_of(condition.operand)
    if isinstance(condition, Var):
        return {condition.name}
    if isinstance(condition, Prop):
        return {condition.var}
    return set()


def comparisons(condition: object | None) -> list:
    """All comparisons and null tests of a condition."""
    if condition is None:
        return []
    if isinstance(condition, (And, Or)):
        return [c for item in condition.items for c in comparisons(item)]
    return [condition]


def label_names(expr: object | None) -> set[str]:
    if expr is None:
        return set()
    if isinstance(expr, Label):
        return {expr.name}
    if isinstance(expr, LabelNot):
        return label_names(expr.item)
    return set().union(*(label_names(i) for i in expr.items))


def holds(expr: object | None, labels: set[str] | frozenset[str]) -> bool:
    """Whether a label expression accepts a set of labels."""
    if expr is None:
        return True
    if isinstance(expr, Label):
        return expr.name in labels
    if isinstance(expr, LabelNot):
        return not holds(expr.item, labels)
    if isinstance(expr, LabelAnd):
        return all(holds(i, labels) for i in expr.items)
    return any(holds(i, labels) for i in expr.items)
