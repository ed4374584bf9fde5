import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import core_oracle, core_queries, graph_queries, io_queries

CORE = {**core_oracle.ORACLE, **graph_queries.ORACLE, **io_queries.ORACLE}
QUERIES = {**core_queries.QUERIES, **graph_queries.QUERIES, **io_queries.QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(CORE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


#: Queries that SQL cannot say, each with the test below that looks at its rows.
WITHOUT_SQL = {"p1_percentiles_by_day_status", "p1_percentiles_by_status", "p2_wide", "p6_found", "p6_instants", "p6_instants_estimated", "p6_zone_estimates"}


def test_every_query_is_checked():
    assert set(QUERIES) - set(CORE) == WITHOUT_SQL


@pytest.mark.parametrize(("name", "keys"), [("p1_percentiles_by_day_status", ["run_day", "status"]), ("p1_percentiles_by_status", ["status"])])
def test_percentiles_against_all_values(spark, sf, name, keys):
    low, high = core_queries.TIME_RANGE
    groups = {}
    for r in spark.read.parquet(f"{sf}/milldb_runs.parquet").collect():
        own = groups.setdefault(tuple(r[k] for k in keys), [])
        if r["time_ms"] is not None and low <= r["time_ms"] <= high:
            own.append(r["time_ms"])
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(groups) * len(core_queries.QUANTILES)
    for r in rows:
        values = groups[tuple(r[k] for k in keys)]
        assert r["n"] == len(values) and r["certified"]
        if values:
            below, upto = sum(v < r["estimate"] for v in values), sum(v <= r["estimate"] for v in values)
            assert (r["rank_low"], r["rank_high"]) == (below, upto)
            assert max(below - r["q"] * len(values), r["q"] * len(values) - upto, 0) <= max(0.005 * len(values), 1)


def read_props(spark, sf):
    zones = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/feeds.parquet").collect()}
    declared = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/prop_keys.parquet").collect()}
    props = [(r["prop_id"], r["variable"], (r["key"] or "").strip(), None if r["value"] is None else r["value"].strip(), r["feed"]) for r in spark.read.parquet(f"{sf}/node_props.parquet").collect()]
    return zones, declared, props


def test_instants_of_all_rows(spark, sf):
    from graphloom.operators.instants import abbreviations, parse_instant

    zones, declared, props = read_props(spark, sf)
    abbr = abbreviations(zones)
    want = {p: parse_instant(v, zones.get(f), abbr)[0] for p, _, k, v, f in props if declared.get(k) == "datetime" and v is not None}
    assert {r["prop_id"]: r["instant_us"] for r in core_queries.p6_instants(spark, sf).collect()} == want
    told = {r["feed"]: r["zone"] for r in core_queries.p6_zone_estimates(spark, sf).collect() if r["zone"]}
    abbr = abbreviations(told)
    want = {p: parse_instant(v, told.get(f), abbr)[0] for p, _, k, v, f in props if declared.get(k) == "datetime" and v is not None}
    assert {r["prop_id"]: r["instant_us"] for r in core_queries.p6_instants_estimated(spark, sf).collect()} == want


def test_wide_rows(spark, sf):
    from graphloom.operators.instants import abbreviations, parse_instant

    zones, declared, props = read_props(spark, sf)
    abbr, last = abbreviations(zones), {}
    for p, variable, key, value, feed in sorted(props):
        if variable is not None and value is not None and key in declared:
            last[variable, key] = (value, feed)
    rows = core_queries.p2_wide(spark, sf).collect()
    assert len(rows) == len({r["variable"] for r in rows}) == len({v for _, v, *_ in props if v is not None})
    got = {(r["variable"], k): r[k] for r in rows for k, t in declared.items() if t == "datetime" and r[k] is not None}
    want = {at: parse_instant(v, zones.get(f), abbr)[0] for at, (v, f) in last.items() if declared[at[1]] == "datetime"}
    assert got == {at: v for at, v in want.items() if v is not None}
    assert {(r["variable"], k) for r in rows for k in r["unfit"] if declared[k] == "datetime"} == {at for at, v in want.items() if v is None}


def test_zone_estimates_are_right_or_null(spark, sf):
    for folder in ("/root/testdata/sf0.1", "/root/testdata/sf0.01", sf):
        if not os.path.exists(folder):
            continue
        declared = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/feeds.parquet").collect()}
        told = core_queries.p6_zone_estimates(spark, folder).collect()
        assert all(r["zone"] in (None, declared[r["feed"]]) and (r["zone"] is None) == (r["reason"] is not None) for r in told)
        if folder.endswith("0.1"):
            assert {r["feed"] for r in told if r["zone"]} == set(declared)


def test_same_instant_pairs(spark, sf):
    """Against all pairs of the small table, with the parser applied to each row by itself."""
    from itertools import combinations

    from graphloom.operators.instants import abbreviations, parse_instant

    zones = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/feeds.parquet").collect()}
    dated = {r[0] for r in spark.read.parquet(f"{sf}/prop_keys.parquet").filter("declared_type = 'datetime'").collect()}
    abbr, groups = abbreviations(zones), {}
    for r in spark.read.parquet(f"{sf}/node_props.parquet").collect():
        key, value = (r["key"] or "").strip(), (r["value"] or "").strip()
        if r["variable"] is not None and key in dated:
            instant = parse_instant(value, zones.get(r["feed"]), abbr)[0]
            if instant is not None:
                groups.setdefault((r["variable"], key, instant), []).append((r["prop_id"], value))
    want = {(min(a[0], b[0]), max(a[0], b[0])) for g in groups.values() for a, b in combinations(g, 2) if a[1] != b[1]}
    assert {tuple(r) for r in core_queries.p6_found(spark, sf).collect()} == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
