"""Percentiles of very large numeric columns by merging centroid digests.

The state of a group is a list of weighted centroids.  Sorted values are clustered so that no
cluster spans more than one unit of the size function ``k(q) = delta * (asin(2q - 1) / pi + 1/2)``,
which keeps clusters small near both ends and bounds the rank width of each.  States are merged by
clustering their centroids again, so the digests of separate partitions, files or days combine
without the rows.  A second pass over the rows counts how many lie below and at each estimate:
that certifies the rank error of every reported percentile instead of trusting the bound.

Defined results
* null, not-a-number, infinite and out-of-range values take no part; they are counted apart.
* a group without a valid value reports null estimates, n = 0 and counts as certified.
* null group keys form a group of their own; repeated rows count as often as they occur.
* an empty table gives no rows.
* key and value columns are taken by name, all other columns are dropped at the scan; a key that is
  named like a result column leaves that column a suffix ``_2``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut_lineage, fresh_name

DELTA = 400
FAN_IN = 256
BUFFER_ROWS = 1 << 18
BROADCAST_GROUPS = 20_000

_STATE = [
    ("__node", T.IntegerType()),
    ("__n", T.LongType()),
    ("__null", T.LongType()),
    ("__nan", T.LongType()),
    ("__out", T.LongType()),
    ("__lo", T.DoubleType()),
    ("__hi", T.DoubleType()),
    ("__mean", T.ArrayType(T.DoubleType(), False)),
    ("__weight", T.ArrayType(T.DoubleType(), False)),
]


def recluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster the weighted values of many groups at once.

    Returns the group, mean and weight of each cluster, ordered by group and mean.
    """
    if not len(value):
        return group[:0], value[:0], weight[:0]
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    upto = np.cumsum(weight)
    before = np.repeat(upto[first] - weight[first], sizes)
    total = np.repeat(np.add.reduceat(weight, first), sizes)
    middle = np.clip((upto - before - weight / 2) / total, 0.0, 1.0)
    cell = np.floor(delta * (np.arcsin(2 * middle - 1) / np.pi + 0.5)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])
    mass = np.add.reduceat(weight, start)
    # the mean of equal values must stay that value, so the sum is taken of distances to the first
    base = value[start]
    spread = np.repeat(base, np.diff(np.r_[start, len(value)]))
    mean = base + np.add.reduceat((value - spread) * weight, start) / mass
    return group[start], mean, mass


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


class _Groups:
    """Numbers group keys in order of appearance and keeps one copy of each."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.seen, self.kept = list(keys), {}, []

    def number(self, batch: pa.RecordBatch) -> np.ndarray:
        if not self.keys:
            self.seen.setdefault((), 0)
            return np.zeros(batch.num_rows, np.int64)
        codes, values = None, []
        for column in _columns(batch, self.keys):
            coded = column.dictionary_encode(null_encoding="encode")
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            values.append(coded.dictionary.to_pylist())
            codes = index if codes is None else codes * len(values[-1]) + index
        uniq, inverse = np.unique(codes, return_inverse=True)
        ids = np.empty(len(uniq), np.int64)
        for i, code in enumerate(uniq.tolist()):
            parts = []
            for value in reversed(values):
                code, at = divmod(code, len(value))
                parts.append(value[at])
            ids[i] = self.seen.setdefault(tuple(reversed(parts)), len(self.seen))
        return ids[inverse]

    def arrays(self, schema: pa.Schema) -> list[pa.Array]:
        rows = list(self.seen)
        return [pa.array([r[i] for r in rows], schema.field(k).type) for i, k in enumerate(self.keys)]

    def __len__(self) -> int:
        return len(self.seen)


def _grown(old: np.ndarray, size: int, fill: float) -> np.ndarray:
    return old if len(old) >= size else np.r_[old, np.full(size - len(old), fill, old.dtype)]


class _Digests:
    """The states of all groups that one task has met."""

    def __init__(self, keys: Sequence[str], delta: int):
        self.groups, self.delta = _Groups(keys), delta
        self.counts = {c: np.zeros(0, np.int64) for c in ("__n", "__null", "__nan", "__out")}
        self.lo, self.hi = np.zeros(0), np.zeros(0)
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def grow(self) -> None:
        size = len(self.groups)
        self.counts = {k: _grown(v, size, 0) for k, v in self.counts.items()}
        self.lo, self.hi = _grown(self.lo, size, np.inf), _grown(self.hi, size, -np.inf)

    def add(self, group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
        self.waiting.append((group, value, weight))
        self.rows += len(value)
        if self.rows >= BUFFER_ROWS:
            self.settle()

    def settle(self) -> None:
        parts = [self.held, *self.waiting]
        self.held = recluster(*(np.concatenate([p[i] for p in parts]) for i in range(3)), self.delta)
        self.waiting, self.rows = [], 0

    def emit(self, node: int, schema: pa.Schema) -> pa.RecordBatch:
        self.settle()
        size = len(self.groups)
        group, mean, mass = self.held
        offsets = pa.array(np.searchsorted(group, np.arange(size + 1)), pa.int32())
        empty = self.counts["__n"] == 0
        own = {
            "__node": pa.array(np.full(size, node, np.int32)),
            **{k: pa.array(v) for k, v in self.counts.items()},
            "__lo": pa.array(self.lo, mask=empty),
            "__hi": pa.array(self.hi, mask=empty),
            "__mean": pa.ListArray.from_arrays(offsets, pa.array(mean)),
            "__weight": pa.ListArray.from_arrays(offsets, pa.array(mass)),
        }
        arrays = [*self.groups.arrays(schema), *(own[n].cast(schema.field(n).type) for n, _ in _STATE)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _state_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(n, t) for n, t in _STATE])


def _build(keys: Sequence[str], delta: int, lo: float | None, hi: float | None, schema_of):
    def run(batches):
        schema = schema_of()
        state, node = _Digests(keys, delta), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(batch.schema.get_field_index("__node"))[0].as_py()
            group = state.groups.number(batch)
            state.grow()
            size = len(state.groups)
            column = batch.column(batch.schema.get_field_index("__value"))
            null = column.is_null().to_numpy(zero_copy_only=False)
            value = column.to_numpy(zero_copy_only=False).astype(np.float64)
            nan = ~null & ~np.isfinite(value)
            with np.errstate(invalid="ignore"):
                out = ~null & ~nan & ((value < (-np.inf if lo is None else lo)) | (value > (np.inf if hi is None else hi)))
            good = ~(null | nan | out)
            for name, mask in (("__null", null), ("__nan", nan), ("__out", out), ("__n", good)):
                state.counts[name] += np.bincount(group[mask], minlength=size)
            group, value = group[good], value[good]
            np.minimum.at(state.lo, group, value)
            np.maximum.at(state.hi, group, value)
            state.add(group, value, np.ones(len(value)))
            if size > 200_000:  # many groups: hand the states on early, merging puts them together
                yield state.emit(node, schema)
                state = _Digests(keys, delta)
        if len(state.groups):
            yield state.emit(node, schema)

    return run


def _merge(keys: Sequence[str], delta: int, schema_of):
    """Merge states that come ordered by node and key: a task holds the states of one batch and one unfinished group."""

    def merged(part: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        nodes = part.column(part.schema.get_field_index("__node")).to_numpy()
        for node in np.unique(nodes).tolist():
            own = part.filter(pa.array(nodes == node))
            state = _Digests(keys, delta)
            group = state.groups.number(own)
            state.grow()
            for name, have in state.counts.items():
                np.add.at(have, group, own.column(own.schema.get_field_index(name)).to_numpy())
            lo, hi, mean, weight = _columns(own, ["__lo", "__hi", "__mean", "__weight"])
            np.minimum.at(state.lo, group, np.nan_to_num(lo.to_numpy(zero_copy_only=False).astype(float), nan=np.inf, posinf=np.inf))
            np.maximum.at(state.hi, group, np.nan_to_num(hi.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf, neginf=-np.inf))
            size = mean.value_lengths().to_numpy()
            state.add(np.repeat(group, size), mean.flatten().to_numpy(), weight.flatten().to_numpy())
            yield state.emit(node, schema)

    def run(batches):
        schema, rest = schema_of(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = {n: batch.column(batch.schema.get_field_index(n))[batch.num_rows - 1].as_py() for n in ("__node", *keys)}
            start = batch.num_rows - 1
            while start and all(batch.column(batch.schema.get_field_index(n))[start - 1].as_py() == v for n, v in last.items()):
                start -= 1
            if start:
                yield from merged(batch.slice(0, start), schema)
            rest = batch.slice(start)
        if rest is not None:
            yield from merged(rest, schema)

    return run


def _arrow_schema(struct: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return lambda: to_arrow_schema(struct)


def build_digests(df: DataFrame, keys: Sequence[str], value: str, *, delta: int = DELTA, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """One digest per group and task.  Nothing is shuffled; a task holds at most its groups' states."""
    struct = _state_schema(df, keys)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`").cast("double").alias("__value"), F.spark_partition_id().alias("__node"))
    return rows.mapInArrow(_build(keys, delta, lo, hi, _arrow_schema(struct)), struct)


def merge_digests(digests: DataFrame, keys: Sequence[str], *, delta: int = DELTA, fan_in: int = FAN_IN, nodes: int | None = None) -> DataFrame:
    """Merge states to one per group in fan-in rounds.

    A round puts the states of ``fan_in`` neighbouring nodes together, and there are as many rounds as ``nodes``
    needs (by default the number of tasks that made the states), so no reducer receives more than ``fan_in``
    states of a group.
    """
    struct = _state_schema(digests, keys)
    run = _merge(keys, delta, _arrow_schema(struct))
    nodes = nodes or max(1, digests._jdf.queryExecution().toRdd().getNumPartitions())
    while True:
        nodes = -(-nodes // fan_in)
        place = [*[F.col(f"`{k}`") for k in keys], F.col("__node")]
        moved = digests.withColumn("__node", F.floor(F.col("__node") / fan_in).cast("int") if nodes > 1 else F.lit(0)).repartition(*place)
        digests = moved.sortWithinPartitions(*reversed(place)).mapInArrow(run, struct)
        if nodes == 1:
            return digests


def _read_off(means: np.ndarray, weights: np.ndarray, lo: float, hi: float, quantiles: Sequence[float]) -> list[float | None]:
    if not len(means):
        return [None] * len(quantiles)
    upto = np.cumsum(weights)
    at = np.r_[0.0, upto - weights / 2, upto[-1]]
    return np.interp(np.asarray(quantiles) * upto[-1], at, np.r_[lo, means, hi]).tolist()


def estimates(digests: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Percentile estimates (array ``__est`` in the order of ``quantiles``) of merged digests."""
    points = [float(q) for q in quantiles]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def read(mean, weight, lo, hi):
        import pandas as pd

        return pd.Series([_read_off(np.asarray(m), np.asarray(w), a, b, points) for m, w, a, b in zip(mean, weight, lo, hi)])

    return digests.select(*[F.col(f"`{k}`") for k in keys], "__n", "__null", "__nan", "__out", read("__mean", "__weight", "__lo", "__hi").alias("__est"))


def certify(df: DataFrame, estimated: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], *, epsilon: float, lo: float | None, hi: float | None, salts: int = 32) -> DataFrame:
    """Count the rows below and at each estimate in a second pass; one row per group and percentile.

    The estimates are one row per group.  Up to ``BROADCAST_GROUPS`` of them are broadcast; beyond
    that both sides are joined by key and salt, so a group that holds a third of the rows is spread
    over ``salts`` tasks.  Counts are combined on the map side in either case.
    """
    v = F.col(f"`{value}`").cast("double")
    valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    if lo is not None:
        valid &= v >= F.lit(float(lo))
    if hi is not None:
        valid &= v <= F.lit(float(hi))
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.filter(valid).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], v.alias("__v"))
    small = estimated.select(*[F.col(f"`{k}`").alias(f"__e{i}") for i, k in enumerate(keys)], "__est")
    on: Column = F.lit(True)
    if estimated.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        small = F.broadcast(small)
    else:
        small = small.withColumn("__es", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("__s", F.pmod(F.xxhash64("__v"), F.lit(salts)).cast("int"))
        on = F.col("__s") == F.col("__es")
    for i, name in enumerate(names):
        on &= F.col(name).eqNullSafe(F.col(f"__e{i}"))
    joined = rows.join(small, on)
    count = [
        F.sum(F.when(test(F.col("__v"), F.element_at("__est", i + 1)), 1).otherwise(0)).alias(f"__{side}{i}")
        for i in range(len(quantiles))
        for side, test in (("below", lambda a, b: a < b), ("upto", lambda a, b: a <= b))
    ]
    counted = joined.groupBy(*names).agg(*count)
    found = estimated.select(*[F.col(f"`{k}`").alias(f"__f{i}") for i, k in enumerate(keys)], "__n", "__null", "__nan", "__out", "__est")
    on = F.lit(True)
    for i, name in enumerate(names):
        on &= F.col(name).eqNullSafe(F.col(f"__f{i}"))
    full = found.join(counted, on, "left")
    points = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.element_at("__est", i + 1).alias("estimate"), F.coalesce(F.col(f"__below{i}"), F.lit(0)).cast("long").alias("below"), F.coalesce(F.col(f"__upto{i}"), F.lit(0)).cast("long").alias("upto"))
        for i, q in enumerate(quantiles)
    ])
    flat = full.withColumn("__p", F.explode(points))
    n = F.col("__n")
    rank = F.col("__p.q") * n
    error = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("__p.below") - rank, rank - F.col("__p.upto")) / n)
    # a group of few rows cannot be cut closer than one row
    allowed = F.greatest(F.lit(float(epsilon)), F.when(n > 0, 1.0 / n).otherwise(0.0))
    columns = [F.col(f"__f{i}") for i in range(len(keys))] + [F.col("__p.q"), n, F.col("__null"), F.col("__nan"), F.col("__out"), F.col("__p.estimate"), F.col("__p.below"), F.col("__p.upto"), error, error <= allowed]
    taken: list[str] = []
    for wish in [*keys, "q", "n", "n_null", "n_nan", "n_out_of_range", "estimate", "rank_low", "rank_high", "rank_error", "certified"]:
        taken.append(fresh_name(taken, wish))
    return flat.select(*[c.alias(name) for c, name in zip(columns, taken)])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), *, delta: int = DELTA, epsilon: float = 0.005, lo: float | None = None, hi: float | None = None, digests: DataFrame | None = None, nodes: int | None = None) -> DataFrame:
    """Certified percentiles of ``value`` per group of ``keys``.

    ``digests`` takes states built before (of days or files, say; ``nodes`` is the number of their node numbers)
    in place of a first pass over the rows.  Values outside ``lo``..``hi`` are implausible and only counted.  Empty tables give no rows.
    """
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    keys = list(keys)
    states = digests if digests is not None else build_digests(df, keys, value, delta=delta, lo=lo, hi=hi)
    found = cut_lineage(estimates(merge_digests(states, keys, delta=delta, nodes=nodes), keys, quantiles))
    return certify(df, found, keys, value, quantiles, epsilon=epsilon, lo=lo, hi=hi)
