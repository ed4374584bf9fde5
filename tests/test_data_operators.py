import math
import random

import pytest

from graphloom.operators import digest, heavy, orphans, pairs, ranks
from graphloom.session import fresh_name


def test_percentiles_are_within_their_certified_rank_error(spark):
    r = random.Random(1)
    rows = [("hot", r.lognormvariate(0, 3)) for _ in range(20000)] + [("cold", float(i)) for i in range(100)] + [("ties", 5.0)] * 500 + [("one", 7.0)] + [(None, float(i)) for i in range(10)]
    rows += [("hot", None), ("hot", math.nan), ("hot", math.inf), ("hot", -1.0), ("none", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    out = digest.percentiles(df, ["k"], "v", (0.0, 0.5, 0.99, 1.0), lo=0.0).collect()
    assert len(out) == 4 * 6
    assert all(x["certified"] for x in out)
    for x in out:
        values = sorted(v for k, v in rows if k == x["k"] and v is not None and math.isfinite(v) and v >= 0)
        assert x["n"] == len(values)
        if not values:
            assert x["estimate"] is None and (x["n_null"], x["n_nan"]) == (1, 1)
            continue
        assert x["rank_low"] == sum(v < x["estimate"] for v in values) and x["rank_high"] == sum(v <= x["estimate"] for v in values)
        assert x["rank_error"] <= max(0.005, 1 / len(values))
    hot = {x["q"]: x for x in out if x["k"] == "hot"}
    assert (hot[0.5]["n_null"], hot[0.5]["n_nan"], hot[0.5]["n_out_of_range"]) == (1, 2, 1)
    assert {x["estimate"] for x in out if x["k"] == "ties"} == {5.0}
    cold = {x["q"]: x["estimate"] for x in out if x["k"] == "cold"}
    assert (cold[0.0], cold[1.0]) == (0.0, 99.0)


def test_digests_of_days_combine_without_rows(spark):
    df = spark.range(10000).selectExpr("id % 10 AS day", "id % 2 AS status", "CAST((id * 7919) % 10007 AS DOUBLE) AS v")
    daily = digest.merge_digests(digest.build_digests(df, ["day", "status"], "v"), ["day", "status"])
    assert daily.count() == 10
    out = digest.percentiles(df, ["status"], "v", (0.25, 0.5), digests=daily).collect()
    assert len(out) == 4 and all(x["certified"] and x["n"] == 5000 for x in out)


def test_many_rounds_and_groups_across_batches(spark):
    df = spark.range(20000).selectExpr("id % 97 AS k", "CAST((id * 7919) % 20011 AS DOUBLE) AS v").repartition(9)
    states = digest.build_digests(df, ["k"], "v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        merged = digest.merge_digests(states, ["k"], fan_in=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(merged) == 97 and sum(r["__n"] for r in merged) == 20000 and all(abs(sum(r["__weight"]) - r["__n"]) < 1e-6 for r in merged)


def test_percentiles_over_everything_and_nothing(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v", "id AS `V2`")
    assert digest.percentiles(df, [], "v", (0.5,)).collect()[0]["certified"]
    assert digest.percentiles(df.limit(0), ["V2"], "v").count() == 0
    with pytest.raises(ValueError):
        digest.percentiles(df, [], "v", ())


def test_keys_named_like_result_columns(spark):
    df = spark.range(100).selectExpr("id % 2 AS n", "CAST(NULL AS INT) AS q", "CAST(id AS DOUBLE) AS v")
    out = digest.percentiles(df, ["n", "q"], "v", (0.5,))
    assert out.columns[:4] == ["n", "q", "q_2", "n_2"]
    assert sorted((r["n"], r["q"], r["q_2"], r["n_2"], r["certified"]) for r in out.collect()) == [(0, None, 0.5, 50, True), (1, None, 0.5, 50, True)]


def test_salted_certification(spark, monkeypatch):
    monkeypatch.setattr(digest, "BROADCAST_GROUPS", 1)
    df = spark.range(3000).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS v")
    assert all(x["certified"] for x in digest.percentiles(df, ["k"], "v", (0.1, 0.9)).collect())


def test_recluster_bounds_clusters_and_keeps_mass():
    import numpy as np

    r = np.random.default_rng(3)
    group, value = r.integers(0, 3, 50000), r.normal(size=50000)
    g, mean, mass = digest.recluster(group, value, np.ones(50000), 100)
    assert mass.sum() == 50000 and all((np.diff(mean[g == i]) >= 0).all() for i in range(3))
    assert all(80 <= (g == i).sum() <= 102 for i in range(3))


EDGES = "edge_id long, from_id string, type string, to_id string, loaded_at timestamp"


def test_tree_aggregate(spark):
    from datetime import datetime, timedelta

    r = random.Random(2)
    rows = [(i, "hot" if r.random() < 0.4 else f"k{r.randrange(50)}", r.choice(["T", "U", None]), r.choice([None, *(f"t{j}" for j in range(300))]), datetime(2024, 1, 1) + timedelta(seconds=r.randrange(1000))) for i in range(3000)]
    rows += [(1, None, "T", "t1", None), (1, "lonely", None, None, None)]
    df = spark.createDataFrame(rows, EDGES)
    for fan_in in (16, 2, 3):
        out = {(x[0], x[1]): tuple(x)[2:] for x in heavy.tree_aggregate(df, ["from_id", "type"], "to_id", "loaded_at", fan_in=fan_in).collect()}
        for field, at in (("from_id", 1), ("type", 2)):
            for key in {x[at] for x in rows}:
                own = [x for x in rows if x[at] == key]
                times = [x[4] for x in own if x[4]]
                assert out.pop((field, key)) == (len(own), len({x[3] for x in own if x[3] is not None}), min(times, default=None), max(times, default=None))
        assert not out
    found = {(x["field"], x["key_value"]) for x in heavy.heavy_keys(df, ["from_id", "type"], "to_id", "loaded_at").collect()}
    assert ("from_id", "hot") in found and ("type", "T") in found and not any(k is None for _, k in found) and len(found) <= 5
    assert heavy.tree_aggregate(df.limit(0), ["type"], "to_id", "loaded_at").count() == 0


REFS = "row_id long, a string, b string, at timestamp"


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_composite_orphans(spark, match):
    keys = [None, "x", "y", "z"]
    refs = [(i, a, b, None) for i, (a, b) in enumerate((a, b) for a in keys for b in keys for _ in range(2))]
    targets = [("x", "x"), ("x", "y"), ("y", None), ("x", "y")]
    got = sorted(r["row_id"] for r in orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, "a string, b string"), ["a", "b"], match=match, hot_keys=2, salts=3).collect())

    def orphan(a, b):
        if a is None and b is None:
            return False
        if a is None or b is None:
            if match == "simple":
                return False
            if match == "full":
                return True
            return not any((a is None or a == x) and (b is None or b == y) for x, y in targets)
        return (a, b) not in targets

    assert got == [i for i, a, b, _ in refs if orphan(a, b)]


def test_orphans_by_lifetime(spark):
    from datetime import datetime

    def at(day):
        return datetime(2024, 1, day)

    r = random.Random(4)
    targets = [(f"k{r.randrange(6)}", *sorted((at(r.randint(1, 28)), at(r.randint(1, 28))))) for _ in range(40)]
    targets += [("k1", at(5), None), ("k7", at(9), at(9)), ("k8", None, None), (None, at(1), None)]
    refs = [(i, r.choice([None, *(f"k{j}" for j in range(10))]), None, r.choice([None, *(at(d) for d in range(1, 29))])) for i in range(400)]
    df = spark.createDataFrame(refs, REFS).withColumnRenamed("a", "variable").drop("b")
    nodes = spark.createDataFrame(targets, "variable string, born timestamp, died timestamp")
    got = sorted(x["row_id"] for x in orphans.find_orphans(df, nodes, ["variable"], at="at", born="born", died="died", salts=3).collect())
    want = [i for i, v, _, t in refs if v is not None and not any(v == n and t and b and b <= t and (d is None or d > t) for n, b, d in targets)]
    assert got == want
    assert orphans.find_orphans(df.limit(0), nodes, ["variable"], at="at", born="born", died="died").count() == 0
    assert orphans.find_orphans(df, nodes.limit(0), ["variable"], at="at", born="born", died="died").count() == sum(v is not None for _, v, _, _ in refs)
    merged = orphans.merged_lifetimes(nodes, ["variable"], "born", "died").collect()
    spans = sorted((x[0] or "", x[1], x[2] or datetime(9999, 1, 1)) for x in merged)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_orphans_keep_columns_of_any_name(spark):
    refs = spark.createDataFrame([("x", 1, 2, 3), ("y", 4, 5, 6)], "k string, __salt long, born long, __hot long")
    out = orphans.find_orphans(refs, spark.createDataFrame([("x",)], "k string"), ["k"])
    assert out.columns == refs.columns and [tuple(r) for r in out.collect()] == [("y", 4, 5, 6)]


def test_orphans_need_sensible_arguments(spark):
    df = spark.createDataFrame([], REFS)
    with pytest.raises(ValueError):
        orphans.find_orphans(df, df, ["a"], match="some")
    with pytest.raises(ValueError):
        orphans.find_orphans(df, df, ["a"], at="at")


def test_differing_pairs(spark):
    from itertools import combinations

    r = random.Random(9)
    rows = [(i, r.choice(["g", "h", None]), r.choice([1, 2]), r.choice(["x", "y", "z", None])) for i in range(60)] + [(100 + i, "hot", 1, "same") for i in range(300)] + [(500, "hot", 1, "other")]
    df = spark.createDataFrame(rows, "Key long, g1 string, g2 long, text string").repartition(3)
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if None not in a + b and a[1:3] == b[1:3] and a[3] != b[3]}
    got = pairs.differing_pairs(df, ["g1", "g2"], "text", "Key")
    assert got.columns == ["Key_a", "Key_b"] and sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert pairs.differing_pairs(df.limit(0), ["g1"], "text", "Key").count() == 0


def test_dense_ranks(spark):
    df = spark.createDataFrame([(f"n{i * 37 % 501}",) for i in range(501)], "id string").repartition(5)
    rows = ranks.dense_ranks(df, ["id"], "rank").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r["id"] for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1, 502))
    assert ranks.dense_ranks(df.limit(0), ["id"], "rank").count() == 0


def test_fresh_names():
    assert fresh_name(["a", "B"], "b") == "b_2" and fresh_name([], "x") == "x"
