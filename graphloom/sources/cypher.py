"""Scripts of Cypher CREATE statements to node and edge rows.

Nodes ``CREATE (v:L1:L2 {key: value, ...})``, edges ``CREATE (a)-[:T {key: value, ...}]->(b)``, several
patterns of one statement separated by commas.  Strings stand in single or double quotes with ``\\`` escapes;
of a list its first element is kept; ``//`` starts a comment.  Ids are the variables.  Statements stand one
a line; ``statements_span_lines`` reads each file as a whole instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphQueryError

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<arrow>\]\s*->|-\s*\[)|(?P<name>`[^`]+`|[A-Za-z_][A-Za-z0-9_]*)|(?P<number>[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<mark>[(){}\[\]:,;])""",
    re.S,
)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphQueryError(f"unexpected text in a CREATE statement: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, re.sub(r"\s", "", m[0]) if m.lastgroup == "arrow" else m[0]
    yield "end", ""


def _string(token: str) -> str:
    """The string between double quotes, as property texts keep it."""
    return '"' + re.sub(r"\\(.)", r"\1", token[1:-1], flags=re.S) + '"'


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = list(_tokens(text)), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, text: str | None = None) -> str:
        kind, value = self.tokens[self.at]
        if kind == "end" or (text is not None and value != text):
            raise GraphQueryError(f"expected {text or 'more'} before {value!r}")
        self.at += 1
        return value

    def sees(self, text: str) -> bool:
        return self.peek()[1] == text

    def value(self) -> str | None:
        kind, token = self.peek()
        if token == "[":
            self.take()
            items = []
            while not self.sees("]"):
                items.append(self.value())
                if self.sees(","):
                    self.take()
            self.take("]")
            return items[0] if items else None
        self.take()
        if kind == "string":
            return _string(token)
        if kind == "name" and self.sees("("):  # datetime('...') and the like
            self.take("(")
            inner = self.value()
            self.take(")")
            return inner.strip('"') if inner else None
        return token

    def props(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if not self.sees("{"):
            return out
        self.take()
        while not self.sees("}"):
            key = self.take().strip("`")
            self.take(":")
            value = self.value()
            if value is not None:
                out[key] = value
            if self.sees(","):
                self.take()
        self.take("}")
        return out

    def node(self) -> tuple[str, list[str], dict[str, str]]:
        self.take("(")
        name = self.take().strip("`") if self.peek()[0] == "name" else ""
        labels = []
        while self.sees(":"):
            self.take()
            labels.append(self.take().strip("`"))
        props = self.props()
        self.take(")")
        return name, labels, props


def parse_create(text: str) -> tuple[list[tuple[str, list[str], dict]], list[tuple[str, str, str, dict]]]:
    """Nodes and edges of a text of CREATE statements."""
    r = _Reader(text)
    nodes, edges = [], []
    while r.peek()[0] != "end":
        while r.sees(";"):
            r.take()
        if r.peek()[0] == "end":
            break
        if r.take().upper() != "CREATE":
            raise GraphQueryError("only CREATE statements are read")
        while True:
            name, labels, props = r.node()
            chain = r.sees("-[")
            if labels or props or not chain:
                nodes.append((name, labels, props))
            while r.sees("-["):
                r.take()
                if r.peek()[0] == "name":
                    r.take()
                r.take(":")
                kind = r.take().strip("`")
                edge_props = r.props()
                r.take("]->")
                target, labels, props = r.node()
                if labels or props:
                    nodes.append((target, labels, props))
                edges.append((name, kind, target, edge_props))
                name = target
            if not r.sees(","):
                break
            r.take()
    return nodes, edges


def read_cypher(spark: SparkSession, path: str, *, statements_span_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of CREATE scripts."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                nodes, edges = parse_create(text)
                rows += [(n, labels, None, None, None, list(props.items())) for n, labels, props in nodes if n]
                rows += [(None, None, a, kind, b, list(props.items())) for a, kind, b, props in edges if a and b]
            yield pd.DataFrame(rows, columns=["id", "labels", "src", "label", "dst", "pairs"])

    lines = spark.read.text(path, wholetext=statements_span_lines).filter(F.length(F.trim("value")) > 0)
    rows = lines.mapInPandas(run, "id string, labels array<string>, src string, label string, dst string, pairs array<struct<k:string,v:string>>")
    rows = rows.withColumn("props", F.map_from_entries("pairs"))
    return rows.filter("id IS NOT NULL").select("id", "labels", "props"), rows.filter("src IS NOT NULL").select("src", "label", "dst", "props")
