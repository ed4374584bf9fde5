"""Multiway joins of edge sets in one shuffle, for cyclic patterns whose pairwise joins would blow up.

The space of bindings is cut into cells by hashing each join variable into its share of buckets; an edge
is sent to every cell that agrees with its two ends.  The shares minimise the number of rows sent.  A hot node
fixes one coordinate only, so its edges still spread over the buckets of their other end.  Edges travel as
packed blocks, one for each cell and some hundred thousand rows, not as rows.  In each cell one
variable after the other is bound, in the order that its own degrees make cheap: each partial binding is
extended from the relation that offers the fewest candidates and kept where all other relations agree, so no
intermediate result exceeds what some relation admits.  Edge numbers are attached last, for complete bindings only.

Two edge sets that meet in a variable of no other set may be folded to one first, where that variable has few
edges: every way through it is then a row between its two neighbours, and sets that send the same rows to the
same cells send them once.

Defined results: rows with a null end take part in nothing; parallel edges each give a row where the
edge is a variable, and count once where it is not; empty relations give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 200_000
CELL_ROWS = 2_000_000
#: Rows that are packed at a time, and bytes of blocks that are handed on at once.
BLOCK, HANDED = 500_000, 8 << 20


@dataclass(frozen=True)
class EdgeSet:
    """Edges as a frame with columns ``s``, ``o`` and, if the edge is a variable with a number, ``e``; rows is an estimate.

    ``times``: the edge is a variable without a number, so parallel edges give a row each.  ``carried``: a node variable
    that column ``c`` binds.  ``apart``: pairs of node variables that differ in every binding asked for.
    """

    df: DataFrame
    src: str
    dst: str
    edge: str | None = None
    rows: float = 1.0
    times: bool = False
    carried: str | None = None
    apart: tuple[tuple[str, str], ...] = ()

    def sends_as(self, other: EdgeSet) -> bool:
        """Whether both send the same rows to the same cells."""
        shape = [(r.src, r.dst, r.edge is None, r.times, r.carried is None) for r in (self, other)]
        return shape[0] == shape[1] and (self.df is other.df or self.df.sameSemantics(other.df))


def folded(one: EdgeSet, two: EdgeSet, through: str, rows: float, conditions: Iterable[Column] = ()) -> EdgeSet:
    """Two sets without edge numbers that meet in ``through`` as one between their other ends, which carries that variable.

    ``conditions`` read columns that are named as the three variables; rows that fail them are left out.
    """
    sides = []
    for r in (one, two):
        end, other = ("s", "o") if r.src == through else ("o", "s")
        df = r.df.filter("s IS NOT NULL AND o IS NOT NULL").select(F.col(end).alias(through), F.col(other).alias(r.dst if end == "s" else r.src))
        sides.append(df if r.times else df.distinct())
    df = sides[0].join(sides[1], through)
    for condition in conditions:
        df = df.filter(condition)
    src, dst = (r.dst if r.src == through else r.src for r in (one, two))
    return EdgeSet(df.select(F.col(src).alias("s"), F.col(dst).alias("o"), F.col(through).alias("c")), src, dst, None, rows, carried=through, apart=(*one.apart, *two.apart))


def shares_of(edge_sets: Sequence[EdgeSet], variables: Sequence[str], cells: int) -> dict[str, int]:
    """Buckets of each variable: at most ``cells`` in all, a small load of each cell and few rows sent.

    Buckets are doubled one variable at a time, each time where the load falls most, so the search grows with
    the number of variables and not with the number of their combinations.
    """
    joined = [v for v in variables if sum(v in (r.src, r.dst) for r in edge_sets) > 1]
    share = dict.fromkeys(variables, 1)

    def cost(own: dict[str, int]) -> tuple[float, float]:
        # the load of a cell counts first, the rows sent decide between equal loads
        load = sum(r.rows / prod(own[v] for v in {r.src, r.dst}) for r in edge_sets)
        return load, sum(r.rows * prod(n for v, n in own.items() if v not in (r.src, r.dst)) for r in edge_sets)

    while 2 * prod(share.values()) <= cells and joined:
        pick = min(joined, key=lambda v: (*cost({**share, v: 2 * share[v]}), share[v]))
        share[pick] *= 2
    return share


class _Adjacency:
    """Distinct pairs of one relation, grouped by one end: the other ends of key ``k`` are ``ends[start[k]:start[k + 1]]``."""

    def __init__(self, key: np.ndarray, end: np.ndarray, size: int):
        order = np.lexsort((end, key))
        self.ends = end[order]
        self.start = np.searchsorted(key[order], np.arange(size + 1))
        self.pairs = key[order] * size + end[order]

    def degree(self, at: np.ndarray) -> np.ndarray:
        return self.start[at + 1] - self.start[at]

    def has(self, key: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        wanted = key * size + end
        place = np.searchsorted(self.pairs, wanted)
        return (place < len(self.pairs)) & (self.pairs[np.minimum(place, len(self.pairs) - 1)] == wanted) if len(self.pairs) else np.zeros(len(wanted), bool)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all spans one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)


class CellJoin:
    """All bindings of one cell.  ``ends``: for each relation its two variables and its coded end arrays."""

    def __init__(self, ends: Sequence[tuple[str, str, np.ndarray, np.ndarray]], size: int, order: Sequence[str] | None = None):
        self.size = size
        self.relations = []
        for src, dst, s, o in ends:
            code = np.unique(s * size + o)
            s, o = code // size, code % size
            self.relations.append((src, dst, _Adjacency(s, o, size), _Adjacency(o, s, size)))
        self.order = list(order) if order else self._cheap_order()

    def _cheap_order(self) -> list[str]:
        """The order of variables, each joined with one before, whose partial bindings are fewest by the mean degrees here.

        From each first variable the next one is taken greedily, so the search grows with the number of variables only.
        """
        known: dict[str, float] = {}
        means = []
        for src, dst, forward, backward in self.relations:
            n_src, n_dst = (max(1, int(np.count_nonzero(side.degree(np.arange(self.size))))) for side in (forward, backward))
            n = len(forward.ends)
            known[src], known[dst] = min(n_src, known.get(src, n_src)), min(n_dst, known.get(dst, n_dst))
            means += [(src, dst, n / n_src, n / (n_src * n_dst)), (dst, src, n / n_dst, n / (n_src * n_dst))]
        best: tuple[float, list[str]] | None = None
        for first in known:
            order, rows = [first], float(known[first])
            total = rows
            while len(order) < len(known):
                after = {}
                for v in known:
                    if v not in order and (steps := sorted((mean, share) for u, w, mean, share in means if w == v and u in order)):
                        # candidates come from the fewest; the other relations keep their share of them
                        after[v] = (rows * steps[0][0], rows * steps[0][0] * prod(share for _, share in steps[1:]))
                v = min(after, key=lambda v: after[v])
                total += after[v][0]
                rows = after[v][1]
                order.append(v)
            if best is None or total < best[0]:
                best = (total, order)
        return best[1]

    def _alone(self, v: str) -> np.ndarray:
        """Values that every relation of a variable knows."""
        found = None
        for src, dst, forward, backward in self.relations:
            if v in (src, dst):
                side = forward if v == src else backward
                own = np.flatnonzero(side.start[1:] > side.start[:-1])
                found = own if found is None else np.intersect1d(found, own, assume_unique=True)
        return found if found is not None else np.zeros(0, np.int64)

    def bindings(self) -> Iterator[dict[str, np.ndarray]]:
        first = self._alone(self.order[0])
        for at in range(0, len(first), CHUNK):
            yield from self._extend({self.order[0]: first[at : at + CHUNK]}, 1)

    def _extend(self, bound: dict[str, np.ndarray], depth: int) -> Iterator[dict[str, np.ndarray]]:
        if depth == len(self.order):
            yield bound
            return
        v, rows = self.order[depth], len(next(iter(bound.values())))
        if not rows:
            return
        sides = [(src, forward) for src, dst, forward, _ in self.relations if dst == v and src in bound] + [(dst, backward) for src, dst, _, backward in self.relations if src == v and dst in bound]
        degrees = np.stack([side.degree(bound[u]) for u, side in sides])
        pick = degrees.argmin(axis=0)
        least = degrees[pick, np.arange(rows)]
        # rows are taken in chunks of so many candidates, so a frontier never exceeds memory
        upto = np.cumsum(least)
        begin = 0
        while begin < rows:
            base = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, base + CHUNK, "right")))
            for i, (u, side) in enumerate(sides):
                own = begin + np.flatnonzero((pick[begin:end] == i) & (least[begin:end] > 0))
                if not len(own):
                    continue
                key = bound[u][own]
                length = side.degree(key)
                value = side.ends[_spans(side.start[key], length)]
                source = np.repeat(own, length)
                keep = np.ones(len(value), bool)
                for j, (w, other) in enumerate(sides):
                    if j != i:
                        keep[keep] = other.has(bound[w][source[keep]], value[keep], self.size)
                source, value = source[keep], value[keep]
                yield from self._extend({**{name: x[source] for name, x in bound.items()}, v: value}, depth + 1)
            begin = end


def elimination_order(edge_sets: Sequence[EdgeSet]) -> list[str]:
    """Variables so that each but the first is joined with one before; those of most relations first."""
    variables = list(dict.fromkeys(v for r in edge_sets for v in (r.src, r.dst)))
    weight = {v: (-sum(v in (r.src, r.dst) for r in edge_sets), sum(r.rows for r in edge_sets if v in (r.src, r.dst))) for v in variables}
    order = [min(variables, key=lambda v: weight[v])]
    while len(order) < len(variables):
        near = [v for v in variables if v not in order and any({v, u} == {r.src, r.dst} for r in edge_sets for u in order)]
        if not near:
            raise ValueError("the relations do not hang together")
        order.append(min(near, key=lambda v: (-sum({v, u} == {r.src, r.dst} for r in edge_sets for u in order), weight[v])))
    return order


def cells_of(edge_sets: Sequence[EdgeSet], cores: int) -> int:
    """As many cells as keep about ``CELL_ROWS`` rows in each, and one for each core at least."""
    return max(cores, int(sum(r.rows for r in edge_sets) / CELL_ROWS * 4) + 1)


def _labels(spark: SparkSession, cells: int) -> list[int]:
    """A number for each cell such that hashing sends no two of them to the same of ``cells`` tasks."""
    found: dict[int, int] = {}
    first, size = 0, 16 * cells
    while len(found) < cells:
        tried = spark.range(first, first + size, 1, 1).select(F.col("id").cast("int").alias("id"))
        for row in tried.groupBy(F.pmod(F.hash("id"), F.lit(cells)).alias("task")).agg(F.min("id").alias("id")).collect():  # one row a cell
            found.setdefault(row[0], row[1])
        first, size = first + size, 2 * size
    return [found[task] for task in range(cells)]


def _pack(columns: Sequence[np.ndarray | pa.Array]) -> bytes:
    """Columns of a block, compressed; whole numbers are counted from the least one and take as few bytes as hold them.

    Of the first column, if it holds whole numbers, in order, the steps are kept.
    """
    least, arrays = [], []
    for i, column in enumerate(columns):
        if isinstance(column, np.ndarray):
            least.append(int(column.min()))
            column = column.view(np.uint64) - column.min().view(np.uint64)
            if i == 0:
                column = np.diff(column, prepend=np.uint64(0))
            column = pa.array(column.astype(np.min_scalar_type(int(column.max()))))
        else:
            least.append(None)
        arrays.append(column)
    batch = pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(str(i), a.type) for i, a in enumerate(arrays)], {"least": json.dumps(least)}))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(block: pa.Buffer) -> list[np.ndarray | pa.ChunkedArray]:
    table = pa.ipc.open_stream(block).read_all()
    out = []
    for i, least in enumerate(json.loads(table.schema.metadata[b"least"])):
        column = table.column(i)
        if least is not None:
            column = column.to_numpy().astype(np.uint64)
            column = (np.cumsum(column) if i == 0 else column).view(np.int64) + np.int64(least)
        out.append(column)
    return out


def _packed(r: int, names: Sequence[str], offsets: Sequence[int], labels: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the least cell of theirs (``place``) to blocks for all their cells."""
    schema = pa.schema([("cell", pa.int32()), ("r", pa.int32()), ("block", pa.binary())])

    def handed(cells: list[int], blocks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([r] * len(cells), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)

    def blocks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place = table.column("place").to_numpy()
        columns = [table.column(c).combine_chunks() for c in names]
        columns = [c.to_numpy() if pa.types.is_int64(c.type) else c for c in columns]
        if all(isinstance(c, np.ndarray) for c in columns[:2]):
            order = np.lexsort((columns[1], columns[0], place))
        else:
            order = np.argsort(place, kind="stable")
        place = place[order]
        columns = [c[order] if isinstance(c, np.ndarray) else c.take(pa.array(order)) for c in columns]
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        cells, blocks, held = [], [], 0
        for at, upto in zip(begin.tolist(), [*begin[1:].tolist(), len(place)]):
            block = _pack([c[at:upto] for c in columns])
            for offset in offsets:
                cells.append(labels[int(place[at]) + offset])
                blocks.append(block)
                held += len(block)
                if held > HANDED:
                    yield handed(cells, blocks)
                    cells, blocks, held = [], [], 0
        if cells:
            yield handed(cells, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from blocks_of(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from blocks_of(pa.Table.from_batches(held))

    return run


@dataclass(frozen=True)
class _Attached:
    """What hangs on the bound pairs of one relation: its rows by pair, with a carried variable and a numbered edge."""

    src: str
    dst: str
    pair: np.ndarray
    carried: str | None
    nodes: np.ndarray | None
    edge: str | None


def _attach(bound: dict[str, np.ndarray], relations: Sequence[_Attached], size: int, apart: Sequence[tuple[str, str]]) -> Iterator[dict[str, np.ndarray]]:
    """Bindings with all rows that hang on their pairs, in chunks; a numbered edge is bound to its place among the rows."""
    for x, y in apart:
        if x in bound and y in bound:
            kept = bound[x] != bound[y]
            bound = {name: values[kept] for name, values in bound.items()}
    rows = len(next(iter(bound.values())))
    if not rows:
        return
    if not relations:
        yield bound
        return
    r = relations[0]
    wanted = bound[r.src] * size + bound[r.dst]
    first = np.searchsorted(r.pair, wanted, "left")
    length = np.searchsorted(r.pair, wanted, "right") - first
    upto = np.cumsum(length)
    begin = 0
    while begin < rows:
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + CHUNK, "right")))
        spot = _spans(first[begin:end], length[begin:end])
        source = np.repeat(np.arange(begin, end), length[begin:end])
        more = {name: values[source] for name, values in bound.items()}
        if r.carried:
            more[r.carried] = r.nodes[spot]
        if r.edge:
            more[r.edge] = spot
        yield from _attach(more, relations[1:], size, apart)
        begin = end


def multiway_join(edge_sets: Sequence[EdgeSet], *, cells: int | None = None) -> DataFrame:
    """All bindings of connected edge sets: a column for each node variable and each edge variable with a number.

    Ends are of one type, long or string; edge numbers are longs or any type that casts to text and back.  A task joins one cell; there are as many cells as keep about
    ``CELL_ROWS`` rows in each, and at least one for each core.
    """
    if any(r.src == r.dst for r in edge_sets):
        raise ValueError("one variable at both ends of an edge")
    order = elimination_order(edge_sets)
    context = edge_sets[0].df.sparkSession.sparkContext
    cells = cells or cells_of(edge_sets, context.defaultParallelism)
    share = shares_of(edge_sets, order, cells)
    stride, total = {}, 1
    for v in order:
        stride[v] = total
        total *= share[v]
    labels = _labels(edge_sets[0].df.sparkSession, total)

    kind = edge_sets[0].df.schema["s"].dataType
    edge_kinds = {r.edge: r.df.schema["e"].dataType for r in edge_sets if r.edge}
    wide = any(not isinstance(k, T.LongType) for k in edge_kinds.values())  # as texts then
    number = "string" if wide else "long"
    parts, sent, layout = None, [], []
    for r in edge_sets:
        known = next((k for k, other in enumerate(sent) if r.sends_as(other)), None)
        layout.append((r.src, r.dst, r.edge, r.carried, r.times, len(sent) if known is None else known))
        if known is not None:
            continue
        rows = r.df.filter("s IS NOT NULL AND o IS NOT NULL")
        if not (r.edge or r.times or r.carried):
            rows = rows.select("s", "o").distinct()
        place = sum((F.pmod(F.xxhash64(F.col(c)), F.lit(share[v])) * F.lit(stride[v]) for c, v in (("s", r.src), ("o", r.dst))), F.lit(0))
        names = ["s", "o", *(["c"] if r.carried else []), *(["e"] if r.edge else [])]
        rows = rows.select(*[F.col(c).cast(number) if c == "e" else F.col(c) for c in names], place.cast("int").alias("place"))
        others = [[k * stride[v] for k in range(share[v])] for v in order if v not in (r.src, r.dst)]
        blocks = rows.mapInArrow(_packed(len(sent), names, [sum(x) for x in product(*others)], labels), "cell int, r int, block binary")
        parts = blocks if parts is None else parts.unionByName(blocks)
        sent.append(r)

    node_vars = [*order, *(r.carried for r in edge_sets if r.carried)]
    edge_vars = [r.edge for r in edge_sets if r.edge]
    struct = T.StructType([T.StructField(v, kind) for v in node_vars] + [T.StructField(e, T.StringType() if wide else T.LongType()) for e in edge_vars])
    ends = [(r.src, r.dst, bool(r.carried)) for r in sent]
    apart = list(dict.fromkeys(pair for r in edge_sets for pair in r.apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(struct)
        got: list[list[list[np.ndarray | pa.ChunkedArray]]] = [[] for _ in ends]
        for batch in batches:
            for r, block in zip(batch.column("r").to_pylist(), batch.column("block")):
                got[r].append(_unpack(block.as_buffer()))
        if not all(got):
            return
        columns = [[np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.chunked_array([x for y in c for x in y.chunks]).combine_chunks() for c in zip(*blocks)] for blocks in got]
        got.clear()
        nodes = [pa.array(c) for (_, _, carries), own in zip(ends, columns) for c in own[: 3 if carries else 2]]
        coded = pa.chunked_array(nodes).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(coded.dictionary))
        codes = iter(np.split(code, np.cumsum([len(c) for c in nodes])[:-1]))
        coded_ends = [tuple(next(codes) for _ in range(3 if carries else 2)) for _, _, carries in ends]
        sorted_by_pair: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        attached, numbers = [], {}
        for src, dst, edge, carried, times, k in layout:
            if not (edge or carried or times):
                continue
            if k not in sorted_by_pair:
                pair = coded_ends[k][0] * size + coded_ends[k][1]
                by_pair = np.argsort(pair, kind="stable")
                sorted_by_pair[k] = pair[by_pair], by_pair
            pair, by_pair = sorted_by_pair[k]
            attached.append(_Attached(src, dst, pair, carried, coded_ends[k][2][by_pair] if carried else None, edge))
            if edge:
                own = columns[k][-1]
                numbers[edge] = pa.array(own).take(pa.array(by_pair))
        columns.clear()
        for bound in CellJoin([(src, dst, *c[:2]) for (src, dst, _), c in zip(ends, coded_ends)], size).bindings():  # chunk by chunk, so no cell's output is gathered
            for part in _attach(bound, attached, size, apart):  # edges hang on bound pairs only, so they multiply out last
                for at in range(0, len(part[order[0]]), CHUNK):
                    at_once = {name: pa.array(values[at : at + CHUNK]) for name, values in part.items()}
                    out = [coded.dictionary.take(at_once[v]) for v in node_vars] + [numbers[e].take(at_once[e]) for e in edge_vars]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)

    # one task a cell: its label decides the task, and a stated number of partitions is not coalesced
    joined = parts.repartition(total, "cell").groupBy("cell").applyInArrow(run, struct)
    return joined.withColumns({e: F.col(f"`{e}`").cast(k) for e, k in edge_kinds.items()}) if wide else joined
