"""From a bound query to a lazy DataFrame.

The planner does what Catalyst cannot know about a graph: which edge and node tables a pattern can
touch at all (types and labels against the tables' endpoints), where the join with a node table can be
left out, and in which order to join.  Predicates, columns and join algorithms are left to Catalyst and AQE.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphQueryError, QueryTimeout
from graphloom.functions.ordinal import as_timestamp, ordinal_of, ordinal_of_text, ordinal_of_timestamp, text_of_ordinal
from graphloom.operators.multiway import EdgeSet, cells_of, elimination_order, folded, multiway_join, shares_of
from graphloom.plans.ast import And, Compare, LabelAnd, Literal, Name, NullTest, Or, Prop, Query, Return, Triple, Var, comparisons, conjuncts, holds, variables_of
from graphloom.plans.binder import check
from graphloom.plans.graph import EdgeSource, PropertyGraph
from graphloom.plans.parser import parse
from graphloom.session import fresh_name

MODES = ("interleaved", "prefilter", "postfilter")
EDGE_SEMANTICS = ("homomorphism", "distinct")
STRATEGIES = ("auto", "pairwise", "multiway")
#: ``auto`` joins a cycle in one shuffle where pair by pair there would be so many times more intermediate rows than rows sent.
MULTIWAY_FACTOR = 30
#: The multiway join folds two edge sets first where that sends fewer rows by such a factor.
FOLD_FACTOR = 2
#: Up to so many relations all join trees are weighed, beyond that the order is greedy.
BUSHY = 10
#: Weight of a join without a shared variable.
CROSS = 1e6
EQUAL_SHARE, RANGE_SHARE = 0.01, 0.3


@dataclass(frozen=True)
class _Hub:
    """How unevenly edges lie on the nodes at one end: the sum of squared rows a node, and of rows at one end times the other."""

    end: str
    edges: frozenset
    squares: float
    both: float

    def joined(self, other: _Hub) -> float:
        if self.edges == other.edges and self.end != other.end:
            return (self.both * other.both) ** 0.5
        return (self.squares * other.squares) ** 0.5


@dataclass
class _Relation:
    df: DataFrame
    variables: frozenset[str]
    rows: float
    exists: bool = False  # only tells whether its variables' values go together
    node: bool = False
    single: bool = False  # its rows are distinct as they are
    hubs: dict[str, _Hub] = field(default_factory=dict)  # of its node variables


class Plan:
    """One query over one graph."""

    def __init__(self, query: Query, graph: PropertyGraph, mode: str = "interleaved", edge_semantics: str = "homomorphism", strategy: str = "auto"):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if edge_semantics not in EDGE_SEMANTICS:
            raise ValueError(f"edge_semantics is one of {EDGE_SEMANTICS}")
        self.strategy = strategy
        self.query, self.graph, self.mode, self.distinct = query, graph, mode, edge_semantics == "distinct"
        self.names = query.variables()
        self.column = {v: f"v{i}" for i, v in enumerate(self.names)}
        self.nodes, self.edges = set(query.node_variables()), set(query.edge_variables())
        self.labels = self._labels()
        self.keys: dict[str, list[str]] = {v: [] for v in self.names}
        for c in comparisons(query.where):
            for x in (c.operand,) if isinstance(c, NullTest) else (c.left, c.right):
                self._wants(x)
        for r in query.returns or ():
            self._wants(r.operand)
        self.ranked = {v for c in comparisons(query.where) if isinstance(c, Compare) for v in self._ranked(c)}
        self.numbered = self._numbered()
        self.sources = [self._sources_of(t) for t in query.triples]
        self.tables = self._prune()

    # what the query needs

    def _wants(self, x) -> None:
        if isinstance(x, Prop) and x.key not in self.keys[x.var]:
            self.keys[x.var].append(x.key)

    def _ranked(self, c: Compare) -> list[str]:
        """Node variables that are compared with a number, that is with their rank."""
        return [x.name for x, y in ((c.left, c.right), (c.right, c.left)) if isinstance(x, Var) and x.name in self.nodes and isinstance(y, Literal) and y.kind == "long"]

    def _numbered(self) -> set[str]:
        """Edge variables whose numbers are asked for; other edges are just rows, which spares their numbering."""
        edges = [t.edge.var for t in self.query.triples if t.edge.var]
        if self.distinct or self.query.returns is None:
            return set(edges)
        shown = {r.operand.name for r in self.query.returns if isinstance(r.operand, Var)}
        compared = {x.name for c in comparisons(self.query.where) if isinstance(c, Compare) for x in (c.left, c.right) if isinstance(x, Var)}
        joined = {e for e in edges if self.keys[e]} if self.strategy == "multiway" else set()  # properties are joined to the edges of a cycle by number
        return {e for e in edges if e in shown | compared | joined or edges.count(e) > 1}

    def _labels(self) -> dict[str, object]:
        """All label expressions of a variable hold together."""
        found: dict[str, list] = {}
        for t in self.query.triples:
            for end in (t.src, t.dst):
                if end.var and end.labels is not None and end.labels not in found.setdefault(end.var, []):
                    found[end.var].append(end.labels)
        return {v: (items[0] if len(items) == 1 else LabelAnd(tuple(items))) for v, items in found.items() if items}

    def prop_column(self, var: str, key: str) -> str:
        return f"{self.column[var]}_p{self.keys[var].index(key)}"

    # which tables a pattern can touch

    def _sources_of(self, t: Triple) -> list[tuple[EdgeSource, frozenset[str]]]:
        same = [o.edge.labels for o in self.query.triples if o.edge.var and o.edge.var == t.edge.var and o.edge.labels is not None] or [t.edge.labels]
        out = []
        for source in self.graph.edges:
            types = frozenset(x for x in source.types if all(holds(expr, {x}) for expr in same))
            if types:
                out.append((source, types))
        return out

    def _prune(self) -> dict[str, frozenset[str]]:
        """Node tables that each variable can lie in; edge sources that lead nowhere are dropped."""
        possible = {v: frozenset(t.name for t in self.graph.nodes if t.test(self.labels.get(v)) is not False) for v in self.nodes}
        while True:
            before = ([len(s) for s in self.sources], dict(possible))
            for i, t in enumerate(self.query.triples):
                kept = []
                for source, types in self.sources[i]:
                    if t.src.var and not source.src_nodes & possible[t.src.var]:
                        continue
                    if t.dst.var and not source.dst_nodes & possible[t.dst.var]:
                        continue
                    kept.append((source, types))
                self.sources[i] = kept
                for var, side in ((t.src.var, "src_nodes"), (t.dst.var, "dst_nodes")):
                    if var:
                        reach = frozenset().union(*(getattr(s, side) for s, _ in kept)) if kept else frozenset()
                        possible[var] &= reach
            if before == ([len(s) for s in self.sources], possible):
                return possible

    def _node_join_needed(self, var: str) -> bool:
        if self.keys[var] or var in self.ranked:
            return True
        sure = frozenset(t for t in self.tables[var] if self.graph.table[t].test(self.labels.get(var)) is True)
        for t, sources in zip(self.query.triples, self.sources):
            for v, side in ((t.src.var, "src_nodes"), (t.dst.var, "dst_nodes")):
                if v == var and all(getattr(s, side) <= sure for s, _ in sources):
                    return False
        return True

    # conditions

    def _value(self, x) -> tuple[Column, str]:
        if isinstance(x, Literal):
            return F.lit(x.value), x.kind
        if isinstance(x, Name):
            return self.graph.locate(x.text), "node"
        if isinstance(x, Var):
            return F.col(self.column[x.name]), "node" if x.name in self.nodes else "edge"
        return F.col(self.prop_column(x.var, x.key)), (self.graph.node_props if x.var in self.nodes else self.graph.edge_props)[x.key]

    def _compare(self, c: Compare) -> Column:
        left, kind_l = self._value(c.left)
        right, kind_r = self._value(c.right)
        numbers = {"long", "double"}
        if "node" in (kind_l, kind_r):
            if kind_l == kind_r:
                if c.op not in ("=", "!="):
                    tables = [t for x in (c.left, c.right) for t in (self.tables[x.name] if isinstance(x, Var) else self.graph.table)]
                    left, right = self.graph.order_text(left, tables), self.graph.order_text(right, tables)
            else:
                node, other = (c.left, c.right) if kind_l == "node" else (c.right, c.left)
                if other.kind == "long":
                    text = F.col(f"{self.column[node.name]}_rank")
                    value = F.lit(other.value)
                else:
                    text, value = self.graph.show(F.col(self.column[node.name])), F.lit(other.value)
                left, right = (text, value) if kind_l == "node" else (value, text)
        elif "edge" in (kind_l, kind_r) or {kind_l, kind_r} <= numbers or kind_l == kind_r == "string":
            pass
        elif {kind_l, kind_r} <= {"datetime", "ordinal"}:
            left, right = self._dates(c.left, left, kind_l, c.right, right, kind_r)
        elif "string" in (kind_l, kind_r) and "datetime" in (kind_l, kind_r) and any(isinstance(x, Literal) and x.kind == "datetime" for x in (c.left, c.right)):
            pass  # a string property that is compared with a text that happens to be a date
        else:
            return F.lit(None).cast("boolean")  # values of different kinds compare as nothing
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.op]

    @staticmethod
    def _dates(x, left: Column, kind_l: str, y, right: Column, kind_r: str) -> tuple[Column, Column]:
        fits = all(not isinstance(s, Literal) or as_timestamp(s.value) for s in (x, y))
        if fits and "ordinal" not in (kind_l, kind_r):
            as_date = lambda s, col: F.lit(as_timestamp(s.value).isoformat(" ")).cast("timestamp_ntz") if isinstance(s, Literal) else col
            return as_date(x, left), as_date(y, right)

        def number(s, column: Column, kind: str) -> Column:
            if isinstance(s, Literal):
                value = ordinal_of(s.value)
                if value is None:
                    raise GraphQueryError(f"not a date and time: {s.value}")
                return F.lit(value)
            return ordinal_of_timestamp(column) if kind == "datetime" else column

        return number(x, left, kind_l), number(y, right, kind_r)

    def condition(self, c) -> Column:
        if isinstance(c, (And, Or)):
            join = (lambda a, b: a & b) if isinstance(c, And) else (lambda a, b: a | b)
            return reduce(join, [self.condition(i) for i in c.items])
        if isinstance(c, NullTest):
            value, _ = self._value(c.operand)
            return value.isNotNull() if c.negated else value.isNull()
        return self._compare(c)

    def _needs(self, c) -> frozenset[str]:
        """The columns that a condition reads."""
        found = set()
        for one in comparisons(c):
            for x in (one.operand,) if isinstance(one, NullTest) else (one.left, one.right):
                if isinstance(x, Prop):
                    found.add(self.prop_column(x.var, x.key))
                elif isinstance(x, Var):
                    found.add(self.column[x.name])
            if isinstance(one, Compare):
                found |= {f"{self.column[v]}_rank" for v in self._ranked(one)}
        return frozenset(found)

    def _share(self, c) -> float:
        if isinstance(c, And):
            return reduce(lambda a, b: a * b, [self._share(i) for i in c.items])
        if isinstance(c, Or):
            return min(1.0, sum(self._share(i) for i in c.items))
        if isinstance(c, NullTest):
            return 0.9 if c.negated else 0.1
        return EQUAL_SHARE if c.op == "=" else 1.0 if c.op == "!=" else RANGE_SHARE

    # relations

    @staticmethod
    def _prop(props: dict[str, tuple[Column, str]], key: str, kind: str) -> Column:
        spark_type = {"long": "long", "double": "double", "datetime": "timestamp_ntz", "ordinal": "long", "string": "string"}[kind]
        if key not in props:
            return F.lit(None).cast(spark_type)
        column, own = props[key]
        if own == kind:
            return column if kind == "string" else column.cast(spark_type)
        if kind == "ordinal":
            return ordinal_of_timestamp(column) if own == "datetime" else ordinal_of_text(column)
        return column.cast(spark_type)

    def _edge_relation(self, t: Triple, props: bool) -> _Relation:
        e = t.edge.var
        parts, rows = [], 0.0
        for source, types in self.sources[self.query.triples.index(t)]:
            df = source.df
            if types != source.types:
                df = df.filter(source.type_column.isin(sorted(types)))
            size = sum(source.rows.get(x, 1.0) for x in types)
            if t.edge.const is not None:
                df, size = df.filter(source.edge(source.df) == F.lit(t.edge.const)), 1.0
            columns = []
            for end, identity, name in ((t.src, source.src, "src"), (t.dst, source.dst, "dst")):
                if end.const:
                    df = df.filter(identity.equals(end.const))
                    size *= EQUAL_SHARE
                elif end.var:
                    columns.append(identity.code().alias(self.column[end.var]))
                elif end.labels is not None:
                    columns.append(identity.code().alias(f"anonymous_{name}"))
            if e:
                if e in self.numbered:
                    columns.append(source.edge(source.df).alias(self.column[e]))
                if props:
                    columns += [self._prop(source.props, k, self.graph.edge_props[k]).alias(self.prop_column(e, k)) for k in self.keys[e]]
            df = df.select(*columns) if columns else df.select(F.lit(1).alias("there"))
            parts.append(df)
            rows += size
        variables = frozenset(v for v in (t.src.var, e, t.dst.var) if v)
        if not parts:
            struct = ", ".join(f"{self.column[v]} {self._type(v)}" for v in (t.src.var, t.dst.var, e if e in self.numbered else None) if v)
            if e and props:
                kinds = {"long": "long", "double": "double", "datetime": "timestamp_ntz", "ordinal": "long", "string": "string"}
                struct += "".join(f", {self.prop_column(e, k)} {kinds[self.graph.edge_props[k]]}" for k in self.keys[e])
            return _Relation(self.graph.spark.createDataFrame([], struct or "there int"), variables, 0.0, False)
        df = reduce(DataFrame.unionByName, parts)
        for end, name in ((t.src, "src"), (t.dst, "dst")):
            if end.const is None and end.var is None and end.labels is not None:
                held = self._nodes(f"anonymous_{name}", end.labels, [t_.name for t_ in self.graph.nodes], [], False)
                df = df.join(held, f"anonymous_{name}", "left_semi").drop(f"anonymous_{name}")
            elif end.const and end.labels is not None and not self.graph.has(end.const, end.labels):
                df = df.limit(0)
        if e and props:
            own = [c for c in conjuncts(self.query.where) if variables_of(c) == {e}] if self.mode != "postfilter" else []
            for c in own:
                df = df.filter(self.condition(c))
                rows *= self._share(c)
        sources = self.sources[self.query.triples.index(t)]
        apart = all(not (a.src_nodes & b.src_nodes and a.dst_nodes & b.dst_nodes) for (a, _), (b, _) in combinations(sources, 2))
        ends = all(end.var or end.const for end in (t.src, t.dst))
        single = ends and apart and all(s.simple and len(types) == 1 for s, types in sources)
        every = sum(s.rows.get(x, 1.0) for s, types in sources for x in types)
        hubs, part = {}, min(1.0, rows / max(every, 1.0)) ** 2
        for end, name in ((t.src, "src"), (t.dst, "dst")):
            if end.var and all(s.squares for s, _ in sources):
                total = lambda what: part * sum(s.squares[what].get(x, 1.0) for s, types in sources for x in types)
                hubs[end.var] = _Hub(name, frozenset((s.name, x) for s, types in sources for x in types), total(name), total("both"))
        return _Relation(df, variables, max(rows, 1.0), exists=e is None, single=single, hubs=hubs)

    def _type(self, var: str) -> str:
        return "long" if self.graph.coded or var in self.edges else "string"

    def _nodes(self, column: str, labels, tables, keys: list[tuple[str, str]], rank: bool) -> DataFrame:
        parts = []
        for name in sorted(tables):
            table = self.graph.table[name]
            test = table.test(labels)
            if test is False:
                continue
            df = table.df if test is True else table.df.filter(test)
            columns = [table.node.code().alias(column)]
            columns += [self._prop(table.props, k, self.graph.node_props[k]).alias(c) for k, c in keys]
            if rank:
                if table.rank is None:
                    raise GraphQueryError("this graph has no node numbers to compare with")
                columns.append(table.rank.alias(f"{column}_rank"))
            parts.append(df.select(*columns))
        if not parts:
            kinds = {"long": "long", "double": "double", "datetime": "timestamp_ntz", "ordinal": "long", "string": "string"}
            struct = f"{column} {'long' if self.graph.coded else 'string'}" + "".join(f", {c} {kinds[self.graph.node_props[k]]}" for k, c in keys)
            return self.graph.spark.createDataFrame([], struct + (f", {column}_rank long" if rank else ""))
        return reduce(DataFrame.unionByName, parts)

    def _node_relation(self, var: str) -> _Relation:
        column = self.column[var]
        keys = [(k, self.prop_column(var, k)) for k in self.keys[var]]
        df = self._nodes(column, self.labels.get(var), self.tables[var], keys, var in self.ranked)
        rows = self._node_rows(var)
        for name in self.tables[var]:
            test = self.graph.table[name].test(self.labels.get(var))
            if not isinstance(test, bool):
                rows -= self.graph.table[name].rows * (1 - 1 / max(2, len(self.graph.table[name].dynamic)))
        if self.mode != "postfilter":
            for c in conjuncts(self.query.where):
                if variables_of(c) == {var}:
                    df = df.filter(self.condition(c))
                    rows *= self._share(c)
        return _Relation(df, frozenset({var}), max(rows, 1.0), exists=not keys and var not in self.ranked, node=True)

    def _node_rows(self, var: str) -> float:
        return max(1.0, sum(self.graph.table[t].rows for t in self.tables[var]))

    # order

    def _joined(self, rows_l: float, bound_l: frozenset[str], rows_r: float, bound_r: frozenset[str], hubs_l: dict[str, _Hub] | None = None, hubs_r: dict[str, _Hub] | None = None) -> float:
        """Estimated rows of a join: each shared variable is one of so many nodes (or edges).

        Where it is known how unevenly both sides lie on the one shared node, the estimate that follows from it
        is taken if it is larger, so hubs count.
        """
        out = rows_l * rows_r
        shared = bound_l & bound_r
        uneven = [hubs_l[v].joined(hubs_r[v]) for v in shared if hubs_l and hubs_r and v in hubs_l and v in hubs_r]
        for v in shared:
            out /= self._node_rows(v) if v in self.nodes else max(1.0, rows_l, rows_r)
        return (max(out, uneven[0]) if len(shared) == 1 and uneven else out) if shared else out * CROSS

    def _order(self, relations: list[_Relation]):
        """A join tree - a relation's number, or a pair of trees - and the estimated rows of all its results.

        Of few relations all trees are weighed, bushy ones too, which keeps the intermediate results of
        cyclic patterns small; of more a greedy chain is taken.
        """
        n = len(relations)
        if n <= BUSHY:
            best = {1 << i: (r.rows, r.rows, r.variables, i) for i, r in enumerate(relations)}
            hubs = {1 << i: r.hubs for i, r in enumerate(relations)}
            for mask in range(1, 1 << n):
                part = (mask - 1) & mask
                while part:
                    rest = mask ^ part
                    if part > rest:
                        cost_l, rows_l, bound_l, tree_l = best[part]
                        cost_r, rows_r, bound_r, tree_r = best[rest]
                        rows = self._joined(rows_l, bound_l, rows_r, bound_r, hubs.get(part), hubs.get(rest))
                        cost = cost_l + cost_r + rows
                        if mask not in best or cost < best[mask][0]:
                            pair = (tree_l, tree_r) if rows_l >= rows_r else (tree_r, tree_l)
                            best[mask] = (cost, rows, bound_l | bound_r, pair)
                    part = (part - 1) & mask
            cost, rows, _, tree = best[(1 << n) - 1]
            return tree, cost - rows
        left = set(range(n))
        tree = min(left, key=lambda i: relations[i].rows)
        left.discard(tree)
        rows, bound = relations[tree].rows, relations[tree].variables
        cost = rows
        while left:
            pick = min(left, key=lambda i: (not relations[i].variables <= bound, not relations[i].variables & bound, self._joined(rows, bound, relations[i].rows, relations[i].variables)))
            rows = self._joined(rows, bound, relations[pick].rows, relations[pick].variables)
            cost += rows if len(left) > 1 else 0
            bound |= relations[pick].variables
            tree = (tree, pick)
            left.discard(pick)
        return tree, cost

    def _edge_conditions(self) -> list[tuple[frozenset[str], Column]]:
        """Edge variables whose types overlap bind different edges; needs two columns each."""
        if not self.distinct:
            return []
        types: dict[str, set[tuple[str, str]]] = {}
        for t, sources in zip(self.query.triples, self.sources):
            if t.edge.var:
                types.setdefault(t.edge.var, set()).update((s.name, x) for s, names in sources for x in names)
        return [(frozenset(self.column[v] for v in pair), F.col(self.column[pair[0]]) != F.col(self.column[pair[1]])) for pair in combinations(types, 2) if types[pair[0]] & types[pair[1]]]

    def dataframe(self) -> DataFrame:
        relations, with_props = [], set()
        for t in self.query.triples:
            relations.append(self._edge_relation(t, props=t.edge.var is not None and t.edge.var not in with_props))
            with_props.add(t.edge.var)
        edge_count = len(relations)
        for v in self.query.node_variables():
            if self._node_join_needed(v):
                relations.append(self._node_relation(v))
        if self.mode == "prefilter":
            for held in relations[edge_count:]:
                (v,) = held.variables
                for i in range(edge_count):
                    if v in relations[i].variables:
                        reduced = relations[i].df.join(held.df.select(self.column[v]), self.column[v], "left_semi")
                        relations[i] = replace(relations[i], df=reduced, rows=max(1.0, relations[i].rows * held.rows / self._node_rows(v)))
        if self.mode == "postfilter":
            waiting = []
        else:
            done = [c for c in conjuncts(self.query.where) if len(variables_of(c)) == 1 and (variables_of(c) <= self.edges or self._placed(c, relations[edge_count:]))]
            waiting = [(self._needs(c), self.condition(c)) for c in conjuncts(self.query.where) if not any(c is d for d in done)]
        waiting += self._edge_conditions()

        tree, cost = self._order(relations)
        if self.strategy == "auto" and cost > MULTIWAY_FACTOR * self._rows_sent(relations):
            return Plan(self.query, self.graph, self.mode, "distinct" if self.distinct else "homomorphism", "multiway").dataframe()
        if self.strategy == "multiway":
            relations = self._with_core(relations, edge_count, [] if self.mode == "postfilter" else [c for c in conjuncts(self.query.where) if not any(c is d for d in done)])
            tree, _ = self._order(relations)

        def build(tree) -> tuple[DataFrame, frozenset[str], frozenset[int]]:
            """The joined rows, their variables and which of the waiting conditions they already satisfy."""
            if isinstance(tree, int):
                out, bound, done = self._rows_of(relations[tree]), relations[tree].variables, frozenset()
            else:
                one, two = tree
                if isinstance(one, int) and relations[one].exists:
                    one, two = two, one
                left, bound_l, done_l = build(one)
                only = relations[two] if isinstance(two, int) and relations[two].exists and relations[two].variables else None
                right, bound_r, done_r = (only.df, only.variables, frozenset()) if only is not None and only.variables <= bound_l else build(two)
                shared = [self.column[v] for v in sorted(bound_l & bound_r)]
                if not shared:
                    out = left.crossJoin(right)
                elif only is not None and only.variables <= bound_l:
                    out = left.join(right, shared, "left_semi")
                else:
                    out = left.join(right, shared)
                bound, done = bound_l | bound_r, done_l | done_r
            there = set(out.columns)
            for i, (needs, condition) in enumerate(waiting):
                if i not in done and needs <= there:
                    out, done = out.filter(condition), done | {i}
            return out, bound, done

        out, _, _ = build(tree)
        if self.mode == "postfilter":
            for c in conjuncts(self.query.where):
                out = out.filter(self.condition(c))
        return self._output(out)

    def _core(self) -> list[int]:
        """The triples between node variables that lie on cycles; none if there is no cycle of three edges."""
        picked = [i for i, t in enumerate(self.query.triples) if t.src.var and t.dst.var]
        while True:  # an end that only one edge touches closes no cycle
            ends = [v for i in picked for v in (self.query.triples[i].src.var, self.query.triples[i].dst.var)]
            kept = [i for i in picked if all(ends.count(v) > 1 for v in (self.query.triples[i].src.var, self.query.triples[i].dst.var))]
            if kept == picked:
                break
            picked = kept
        named = [self.query.triples[i].edge.var for i in picked if self.query.triples[i].edge.var]
        return [] if len(picked) < 3 or len(set(named)) < len(named) else picked

    def _rows_sent(self, relations: list[_Relation]) -> float:
        """Estimated rows that the multiway join of the core would send; infinite if it is no choice."""
        sets = [EdgeSet(None, self.column[self.query.triples[i].src.var], self.column[self.query.triples[i].dst.var], None, relations[i].rows) for i in self._core()]
        if not sets:
            return float("inf")
        try:
            return self._sent(sets)
        except ValueError:  # two cycles without a common variable
            return float("inf")

    def _sent(self, sets: list[EdgeSet]) -> float:
        share = shares_of(sets, elimination_order(sets), cells_of(sets, self.graph.spark.sparkContext.defaultParallelism))
        return sum(r.rows * prod(n for v, n in share.items() if v not in (r.src, r.dst)) for r in sets)

    def _folded(self, sets: list[EdgeSet], hubs: dict[tuple[str, str, str], list[_Hub | None]], conditions: list) -> list[EdgeSet]:
        """The sets, with two that meet in a variable of no other set folded to one wherever that sends far fewer rows.

        The rows through the variable count as sent, and those of the two sets, which are shuffled for it; hubs count where
        they are known.  Conditions on the three variables hold in the folded set.
        """
        name = {self.column[v]: v for v in self.nodes}
        while True:
            best = None
            for v in {x: None for r in sets for x in (r.src, r.dst)}:
                pair = [r for r in sets if v in (r.src, r.dst)]
                ends = [r.dst if r.src == v else r.src for r in pair]
                if len(pair) != 2 or ends[0] == ends[1] or any(r.edge or r.carried for r in pair):
                    continue
                through = pair[0].rows * pair[1].rows / self._node_rows(name[v])
                known = [hubs[r.src, r.dst, v] for r in pair]
                if all(len(h) == 1 and h[0] for h in known):
                    through = max(through, known[0][0].joined(known[1][0]))
                own = [c for c in conditions if self._needs(c) <= {v, *ends}]
                through *= prod(self._share(c) for c in own)
                rest = [r for r in sets if r not in pair]
                new = [*rest, EdgeSet(None, *ends, None, max(through, 1.0), carried=v)]
                cost = self._sent(new) + sum(r.rows for r in pair)
                if best is None or cost < best[0]:
                    best = (cost, v, pair, own, max(through, 1.0), rest)
            if best is None or FOLD_FACTOR * best[0] > self._sent(sets):
                return sets
            _, v, pair, own, rows, rest = best
            sets = [*rest, folded(*pair, v, rows, [self.condition(c) for c in own])]

    def _with_core(self, relations: list[_Relation], edge_count: int, conditions: list) -> list[_Relation]:
        """The relations with the edges between node variables of a cyclic pattern joined to one.

        Node conditions and labels reduce those edges first; node tables join again afterwards where their
        properties are asked for.  Patterns without such a cycle are refused.  ``conditions`` may be tested on the way.
        """
        picked = self._core()
        if not picked:
            raise GraphQueryError("the multiway strategy needs a cycle of three edges whose edge variables differ")
        sets, spare, hubs = [], [], {}
        apart = tuple(  # an order of two nodes says that they differ
            (self.column[c.left.name], self.column[c.right.name])
            for c in conditions
            if isinstance(c, Compare) and c.op in ("<", ">", "!=") and isinstance(c.left, Var) and isinstance(c.right, Var) and {c.left.name, c.right.name} <= self.nodes
        )
        for i in picked:
            t, r = self.query.triples[i], relations[i]
            df = r.df
            for held in relations[edge_count:]:
                (v,) = held.variables
                if v in r.variables:
                    df = df.join(held.df.select(self.column[v]), self.column[v], "left_semi")
            s, o = self.column[t.src.var], self.column[t.dst.var]
            e = self.column[t.edge.var] if t.edge.var in self.numbered else None
            times = t.edge.var is not None and e is None
            sets.append(EdgeSet(df.select(F.col(s).alias("s"), F.col(o).alias("o"), *([F.col(e).alias("e")] if e else [])), s, o, e, r.rows, times, apart=apart))
            for v in (t.src.var, t.dst.var):
                hubs.setdefault((s, o, self.column[v]), []).append(r.hubs.get(v))
            if e and (self.keys[t.edge.var] and self.prop_column(t.edge.var, self.keys[t.edge.var][0]) in r.df.columns):
                spare.append(replace(r, df=r.df.drop(s, o), variables=frozenset({t.edge.var})))
        try:
            df = multiway_join(self._folded(sets, hubs, conditions))
        except ValueError as error:
            raise GraphQueryError("the multiway strategy needs cycles that hang together") from error
        variables = frozenset(v for i in picked for v in relations[i].variables)
        core = _Relation(df, variables, min(r.rows for r in (relations[i] for i in picked)), single=True)
        nodes = [r for r in relations[edge_count:] if not (r.exists and r.variables <= variables)]
        return [core, *spare, *(r for i, r in enumerate(relations[:edge_count]) if i not in picked), *nodes]

    def _placed(self, c, node_relations: list[_Relation]) -> bool:
        return any(r.variables == variables_of(c) for r in node_relations)

    def _rows_of(self, r: _Relation) -> DataFrame:
        """An anonymous edge says that its ends are joined, however often; node ids are unique anyhow."""
        if not r.variables:
            return r.df.limit(1).select()
        return r.df.distinct() if r.exists and not r.node and not r.single else r.df

    def _output(self, df: DataFrame) -> DataFrame:
        items = self.query.returns or tuple(Return(Var(v), v) for v in self.names)
        columns, taken = [], []
        for item in items:
            name = fresh_name(taken, item.alias)
            taken.append(name)
            if isinstance(item.operand, Var):
                v = item.operand.name
                value = self.graph.show(F.col(self.column[v]), self.tables[v]) if v in self.nodes else F.col(self.column[v])
            else:
                value, kind = self._value(item.operand)
                if kind == "ordinal":
                    value = text_of_ordinal(value)
            columns.append(value.alias(name))
        df = df.select(*columns)
        return df if self.query.limit is None else df.limit(self.query.limit)


def match(graph: PropertyGraph, query: str | Query, *, mode: str = "interleaved", edge_semantics: str = "homomorphism", strategy: str = "auto", limit: int | None = None, check_constants: bool = True) -> DataFrame:
    """The bindings of a pattern as a lazy DataFrame, one row for each assignment of all variables.

    Columns: the RETURN items, or all variables in order of first appearance; a node is its id, an edge
    its number.  ``mode`` places the filters: among the joins, as semi-join reducers before them, or after
    them.  ``strategy``: ``pairwise`` joins relation by relation; ``multiway`` joins the edges of a cycle in one shuffle,
    for cycles whose pairs are far more than their closings, and refuses patterns without a cycle of three edges,
    with an edge variable used twice there, or of two cycles apart; ``auto`` picks by estimated rows.  ``edge_semantics='distinct'`` keeps different edge variables on different edges.  ``limit`` takes
    any so many rows.  Empty tables give no rows; a missing property fails every comparison, also ``!=``.
    """
    tree = parse(query) if isinstance(query, str) else query
    check(tree, graph, constants=check_constants)
    if limit:
        tree = replace(tree, limit=limit if tree.limit is None else min(limit, tree.limit))
    return Plan(tree, graph, mode, edge_semantics, strategy).dataframe()


def within(df: DataFrame, seconds: float, action=DataFrame.count):
    """``action(df)``, cancelled with :class:`QueryTimeout` after so many seconds (never a partial result)."""
    context = df.sparkSession.sparkContext
    group = f"graphloom-{id(df)}-{threading.get_ident()}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return action(df)
    except Exception as error:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
