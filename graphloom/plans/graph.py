"""A property graph as tables of nodes and edges, and the catalog of its names.

Node identities inside a plan are either the id strings themselves or, where ids are made of a prefix and
a whole number, one LONG (table number in the high bits), so joins run on longs and the id text is made
only for rows that come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphQueryError
from graphloom.plans.ast import Label, LabelAnd, LabelNot

SHIFT = 56


@dataclass(frozen=True)
class Identity:
    """How a table says which node a row means: a text column, or a number column of a prefixed table."""

    raw: Column
    prefix: str | None = None
    number: int = 0

    def code(self) -> Column:
        if self.prefix is None:
            return self.raw
        return self.raw.cast("long") + F.lit(self.number << SHIFT)

    def equals(self, text: str) -> Column:
        if self.prefix is None:
            return self.raw == F.lit(text)
        digits = text[len(self.prefix) :]
        if not text.startswith(self.prefix) or not digits.isdigit() or str(int(digits)) != digits or len(digits) > 16:
            return F.lit(False)
        return self.raw == F.lit(int(digits))


@dataclass(frozen=True)
class NodeTable:
    """Nodes that all carry ``labels`` and each some of ``dynamic`` (tested by ``label_test``).

    ``load`` gives the rows; it is called only for tables that a query can touch.
    """

    name: str
    load: Callable[[], DataFrame]
    node: Identity
    labels: frozenset[str]
    props: dict[str, tuple[Column, str]] = field(default_factory=dict)
    dynamic: frozenset[str] = frozenset()
    label_test: Callable[[str], Column] | None = None
    rank: Column | None = None
    known_rows: float | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.load()

    @cached_property
    def rows(self) -> float:
        return self.known_rows if self.known_rows is not None else estimated_rows(self.df)

    def test(self, expr) -> bool | Column:
        """Whether the table's nodes satisfy a label expression: always, never, or a condition."""
        if expr is None:
            return True
        if isinstance(expr, Label):
            if expr.name in self.labels:
                return True
            return self.label_test(expr.name) if expr.name in self.dynamic else False
        if isinstance(expr, LabelNot):
            inner = self.test(expr.item)
            return not inner if isinstance(inner, bool) else ~inner
        every = isinstance(expr, LabelAnd)
        out: bool | Column = every
        for item in expr.items:
            one = self.test(item)
            if isinstance(one, bool):
                if one is not every:
                    return one
            else:
                out = one if isinstance(out, bool) else (out & one if every else out | one)
        return out


@dataclass(frozen=True)
class EdgeSource:
    """Edges of one or more types; ``src_nodes`` and ``dst_nodes`` name the tables that their ends lie in.

    ``edge`` makes the edge's number out of the rows; ``simple`` says that no two edges join the same ends.
    """

    name: str
    load: Callable[[], DataFrame]
    edge: Callable[[DataFrame], Column]
    src: Identity
    dst: Identity
    types: frozenset[str]
    src_nodes: frozenset[str]
    dst_nodes: frozenset[str]
    type_column: Column | None = None
    props: dict[str, tuple[Column, str]] = field(default_factory=dict)
    known_rows: dict[str, float] | None = None
    simple: bool = False
    #: over all nodes and for each type the sums of squared out-degrees (``src``) and in-degrees (``dst``) and of their products (``both``)
    squares: dict[str, dict[str, float]] | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.load()

    @cached_property
    def rows(self) -> dict[str, float]:
        """Rows of each type, by size where they are not known."""
        return self.known_rows or dict.fromkeys(self.types, estimated_rows(self.df) / max(1, len(self.types)))


#: Of so many files the footers are looked at when rows are estimated.
FOOTERS = 4


def _footer_rows(df: DataFrame) -> float | None:
    """Rows of a plain Parquet table by its size and the row counts in a few footers; None for anything else.

    An estimate for the order of joins only; it needs no job and reads a bounded number of footers.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.nodeName().split(" ")[0] not in ("Relation", "LogicalRelation"):
        return None
    location = plan.relation().location()
    total = float(location.sizeInBytes())
    files = location.inputFiles()
    paths = [files[i] for i in range(0, len(files), max(1, len(files) // FOOTERS))][:FOOTERS]
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    rows = size = 0
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        size += where.getFileSystem(conf).getFileStatus(where).getLen()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
        try:
            rows += reader.getRecordCount()
        finally:
            reader.close()
    return total * rows / size if size else 0.0


def estimated_rows(df: DataFrame) -> float:
    """Rows by Parquet footers, else by the optimizer's size estimate; needs no job."""
    try:
        if (rows := _footer_rows(df)) is not None:
            return max(1.0, rows)
    except Exception:  # another reader or file system: the size will do
        pass
    try:
        size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return 1e6
    width = sum(20 if isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType)) else 8 for f in df.schema.fields) or 8
    return max(1.0, size / width)


class PropertyGraph:
    """Node and edge tables with the names that queries may use."""

    def __init__(self, spark: SparkSession, nodes: Iterable[NodeTable], edges: Iterable[EdgeSource]):
        self.spark, self.nodes, self.edges = spark, list(nodes), list(edges)
        self.table = {n.name: n for n in self.nodes}
        self.coded = any(n.node.prefix is not None for n in self.nodes)
        if self.coded and not all(n.node.prefix for n in self.nodes):
            raise ValueError("either all node tables have a prefix or none")
        self.node_labels = frozenset().union(*(n.labels | n.dynamic for n in self.nodes)) if self.nodes else frozenset()
        self.edge_types = frozenset().union(*(e.types for e in self.edges)) if self.edges else frozenset()
        self.node_props = self._kinds(n.props for n in self.nodes)
        self.edge_props = self._kinds(e.props for e in self.edges)

    @staticmethod
    def _kinds(tables: Iterable[dict[str, tuple[Column, str]]]) -> dict[str, str]:
        out: dict[str, str] = {}
        for props in tables:
            for key, (_, kind) in props.items():
                have = out.setdefault(key, kind)
                if have != kind:
                    out[key] = "double" if {have, kind} == {"long", "double"} else "ordinal" if {have, kind} == {"datetime", "ordinal"} else "string"
        return out

    def show(self, code: Column, tables: Iterable[str] | None = None) -> Column:
        """The id text of a node identity."""
        if not self.coded:
            return code
        within = [self.table[t] for t in tables] if tables else self.nodes
        key = code.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("string")
        if len(within) == 1:
            return F.concat(F.lit(within[0].node.prefix), key)
        number = F.shiftright(code, SHIFT)
        prefix = None
        for t in within:
            prefix = F.when(number == t.node.number, t.node.prefix) if prefix is None else prefix.when(number == t.node.number, t.node.prefix)
        return F.concat(prefix, key)

    def order_text(self, code: Column, tables: Iterable[str]) -> Column:
        """What a node identity sorts by: its id text, of which the prefix may go where only one table is in question."""
        if self.coded and len(set(tables)) == 1:
            return code.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("string")
        return self.show(code)

    def locate(self, text: str) -> Column:
        """The identity of a node id as a literal (not checked for existence)."""
        if not self.coded:
            return F.lit(text)
        for t in sorted(self.nodes, key=lambda t: -len(t.node.prefix)):
            digits = text[len(t.node.prefix) :]
            if text.startswith(t.node.prefix) and digits.isdigit() and str(int(digits)) == digits and len(digits) <= 16:
                return F.lit((t.node.number << SHIFT) + int(digits))
        raise GraphQueryError(f"unknown node: {text}")

    def has(self, text: str, labels=None) -> bool:
        """Whether a node of this id exists (and satisfies a label expression); one filtered scan a table."""
        for t in self.nodes:
            test = t.test(labels)
            if test is False or (t.node.prefix and not text.startswith(t.node.prefix)):
                continue
            found = t.df.filter(t.node.equals(text))
            if test is not True:
                found = found.filter(test)
            if found.limit(1).count():
                return True
        return False

    def has_edge(self, number: int) -> bool:
        """Whether an edge of this number exists; one filtered scan a source."""
        return any(source.df.filter(source.edge(source.df) == F.lit(number)).limit(1).count() for source in self.edges)
