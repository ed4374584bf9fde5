import random
from dataclasses import replace
from decimal import Decimal
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import graph_queries
from graphloom.operators import multiway
from graphloom.operators.multiway import EdgeSet, folded, multiway_join, shares_of
from graphloom.plans import planner


def brute(relations):
    """relations: (src, dst, edge, rows of (s, o, e))."""
    partial = [{}]
    for src, dst, edge, rows in relations:
        seen = {(s, o, e if edge else None) for s, o, e in rows if s is not None and o is not None}
        partial = [{**b, src: s, dst: o, **({edge: e} if edge else {})} for b, (s, o, e) in product(partial, seen) if b.get(src, s) == s and b.get(dst, o) == o]
    return sorted(tuple(sorted(b.items())) for b in partial)


def edges(seed, n, m, text=False):
    r = random.Random(seed)
    node = lambda: (f"n{r.randrange(n)}" if text else r.randrange(n)) if r.random() < 0.97 else None
    hot = "n0" if text else 0
    return [(hot if r.random() < 0.3 else node(), node(), i) for i in range(m)]


SHAPES = {
    "triangle": [("a", "b", "e"), ("b", "c", None), ("c", "a", "g")],
    "square": [("a", "p", None), ("b", "p", None), ("a", "q", None), ("b", "q", None)],
    "same ends": [("a", "b", "e"), ("a", "b", "f"), ("b", "a", None)],
    "tail": [("a", "b", None), ("b", "c", None), ("c", "a", None), ("c", "d", "h")],
    "chain": [("a", "b", "e"), ("b", "c", "f")],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("cells", [1, 16])
def test_against_pairwise_loops(spark, shape, cells, monkeypatch):
    monkeypatch.setattr(multiway, "CHUNK", 7)  # many small chunks
    text = shape in ("triangle", "chain")
    relations = [(s, d, e, edges(i, 9, 40, text)) for i, (s, d, e) in enumerate(SHAPES[shape])]
    kind = "string" if text else "long"
    sets = [EdgeSet(spark.createDataFrame(rows, f"s {kind}, o {kind}, e long"), s, d, e, len(rows)) for s, d, e, rows in relations]
    rows = multiway_join(sets, cells=cells).collect()
    assert sorted(tuple(sorted(r.asDict().items())) for r in rows) == brute(relations)


@pytest.mark.parametrize("cells", [1, 16])
def test_wide_edge_numbers(spark, cells):
    big = 10**36
    relations = [(s, d, e, [(a, b, (big if e == "e" else 0) + n) for a, b, n in edges(i, 9, 40)]) for i, (s, d, e) in enumerate(SHAPES["same ends"])]
    sets = [EdgeSet(spark.createDataFrame([(a, b, Decimal(n) if e == "e" else n) for a, b, n in rows], f"s long, o long, e {'decimal(38,0)' if e == 'e' else 'long'}"), s, d, e, len(rows)) for s, d, e, rows in relations]
    got = multiway_join(sets, cells=cells)
    assert dict(got.dtypes)["e"] == "decimal(38,0)" and dict(got.dtypes)["f"] == "bigint"
    assert sorted(tuple(sorted({k: int(v) for k, v in r.asDict().items()}.items())) for r in got.collect()) == brute(relations)


@pytest.mark.parametrize("name", ["cycle_square_multiway", "cycle_local_multiway"])
def test_table_of_several_files_is_joined_in_one_shuffle(spark, sf, tmp_path, monkeypatch, name):
    for file in Path(sf).iterdir():
        if file.name == "lineitem.parquet":
            spark.read.parquet(str(file)).repartition(3).write.parquet(str(tmp_path / file.name))
        else:
            (tmp_path / file.name).symlink_to(file)
    one, three = (graph_queries.opened_graph(spark, str(d)) for d in (sf, tmp_path))
    named = [planner.match(g, "(?o)-[?e:CONTAINS]->(?p)") for g in (one, three)]
    assert named[0].dtypes == named[1].dtypes and dict(named[1].dtypes)["e"] == "bigint"
    assert named[1].select("e").distinct().count() == named[1].count() == named[0].count()
    calls = []
    monkeypatch.setattr(planner, "multiway_join", lambda sets: calls.append(sets) or multiway_join(sets))
    got = graph_queries.QUERIES[name](spark, str(tmp_path))
    assert calls and sorted(map(tuple, got.collect())) == sorted(map(tuple, graph_queries.QUERIES[name](spark, sf).collect()))


def test_empty_and_loose_relations(spark):
    empty = spark.createDataFrame([], "s long, o long, e long")
    one = spark.createDataFrame([(1, 2, 3)], "s long, o long, e long")
    assert multiway_join([EdgeSet(empty, "a", "b"), EdgeSet(one, "b", "a")]).count() == 0
    with pytest.raises(ValueError):
        multiway_join([EdgeSet(one, "a", "b"), EdgeSet(one, "c", "d")])
    with pytest.raises(ValueError):
        multiway_join([EdgeSet(one, "a", "a")])


def test_cell_binds_in_an_order_without_cross_products(monkeypatch):
    r = np.random.default_rng(5)
    n_c, n_s, n_o = 3000, 1000, 4000
    c, s, o, n = np.arange(n_c), n_c + np.arange(n_s), n_c + n_s + np.arange(n_o), n_c + n_s + n_o
    nation_c, nation_s = n + r.integers(0, 3, n_c), n + r.integers(0, 3, n_s)
    placed, order, shipper = r.integers(0, n_c, n_o), r.integers(0, n_o, 3 * n_o), r.integers(0, n_s, 3 * n_o)
    ends = [("c", "n", c, nation_c), ("s", "n", s, nation_s), ("c", "o", placed, o), ("o", "s", o[order], s[shipper])]
    tried, spans = [], multiway._spans
    monkeypatch.setattr(multiway, "_spans", lambda start, length: tried.append(int(length.sum())) or spans(start, length))
    rows = sum(len(b["c"]) for b in multiway.CellJoin(ends, n + 3).bindings())
    pairs = np.unique(order * n_s + shipper)
    assert rows == (nation_c[placed[pairs // n_s]] == nation_s[pairs % n_s]).sum()
    assert sum(tried) < 3 * sum(len(e[2]) for e in ends)  # nation by nation there are a million pairs of customer and supplier


@pytest.mark.parametrize("cells", [1, 16])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_parallel_edges_without_numbers_count_each(spark, kind, cells):
    relations = [(s, d, e, edges(i, 9, 40, kind == "string")) for i, (s, d, e) in enumerate([("a", "b", "e"), ("b", "c", None), ("c", "a", "g")])]
    sets = [EdgeSet(spark.createDataFrame([r[:2] for r in rows], f"s {kind}, o {kind}"), s, d, None, len(rows), times=e is not None) for s, d, e, rows in relations]
    got = multiway_join(sets, cells=cells).select("a", "b", "c").collect()
    assert sorted(map(tuple, got)) == sorted((b["a"], b["b"], b["c"]) for b in map(dict, brute(relations)))


@pytest.mark.parametrize("cells", [1, 16])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_folded_square(spark, kind, cells):
    rows = edges(7, 9, 60, kind == "string")
    one = spark.createDataFrame([r[:2] for r in rows], f"s {kind}, o {kind}")
    square = [("a", "p", "e"), ("b", "p", None), ("a", "q", "f"), ("b", "q", None)]
    sets = [EdgeSet(one, s, d, None, len(rows), times=e is not None, apart=(("a", "b"), ("p", "q"))) for s, d, e in square]
    pair = [folded(sets[0], sets[2], "a", 100, [F.col("p") < F.col("q")]), folded(sets[1], sets[3], "b", 100, [F.col("p") < F.col("q")])]
    want = sorted((b["a"], b["b"], b["p"], b["q"]) for b in map(dict, brute([(s, d, e, rows) for s, d, e in square])) if b["a"] != b["b"] and b["p"] < b["q"])
    assert want and sorted(map(tuple, multiway_join(pair, cells=cells).select("a", "b", "p", "q").collect())) == want
    other = folded(replace(sets[0], src="b"), replace(sets[2], src="b"), "b", 100, [F.col("p") < F.col("q")])
    assert pair[0].sends_as(other) and not pair[0].sends_as(pair[1])


def test_square_in_many_cells_sends_ways_through_orders_once(spark, sf, monkeypatch):
    calls = []
    monkeypatch.setattr(planner, "multiway_join", lambda sets: calls.append(sets) or multiway_join(sets, cells=16))
    monkeypatch.setattr(planner, "cells_of", lambda sets, cores: 256)  # as many as 36 million edges take
    got = graph_queries.QUERIES["cycle_square_multiway"](spark, sf)
    (sets,) = calls
    assert len(sets) == 2 and sets[0].sends_as(sets[1]) and {r.df.columns[0] for r in sets} == {"s"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph_queries.QUERIES["cycle_square_parts"](spark, sf).collect()))


def test_shares():
    class Rows:
        pass

    sets = [EdgeSet(Rows(), a, b, None, 1e6) for a, b in (("x", "y"), ("y", "z"), ("z", "x"))]
    assert shares_of(sets, ["x", "y", "z"], 64) == {"x": 4, "y": 4, "z": 4}
    assert np.prod(list(shares_of(sets, ["x", "y", "z"], 10).values())) <= 10


def test_many_variables_share_cells_quickly():
    ring = [EdgeSet(None, f"v{i}", f"v{(i + 1) % 12}", None, 1e9) for i in range(12)]
    assert np.prod(list(shares_of(ring, [f"v{i}" for i in range(12)], 1 << 12).values())) == 1 << 12


def test_files_get_numbers_of_their_own():
    from graphloom.sources.rownumbers import _HALF, _hash, file_shifts

    for n in (2, 3, 7, 1000, 20_000):
        paths = [f"file:///data/t/part-{i:05d}.parquet" for i in range(n)]
        shifts, size = file_shifts(paths)
        hashes = [_hash(p) for p in paths]
        assert len({((h & _HALF) + shifts[h % len(shifts)] * (h >> 31 & _HALF | 1)) % _HALF % size for h in hashes}) == n and size < 4 * n
    with pytest.raises(ValueError):
        file_shifts(["a", "a"])
