import math
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from graphloom.operators import instants, rejects, wide

PROPS = "prop_id long, variable string, key string, value string, feed string, loaded_at timestamp"
DECLARED = {"n": "long", "d": "double", "s": "string", "t": "datetime", "variable": "long", "N": "double", "unused": "long"}
ZONES = {"berlin": "Europe/Berlin", "dump": "UTC", "east": "America/New_York"}


def us(*parts):
    return int((datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def wide_rows(spark, rows, **kwargs):
    df = spark.createDataFrame([(i + 1, *r, None) for i, r in enumerate(rows)], PROPS).repartition(3)
    out = wide.widen(df, DECLARED, ZONES, feed="feed", **kwargs)
    return out, {r["variable"]: r.asDict() for r in out.collect()}


def test_last_statement_wins_and_types_hold(spark):
    out, got = wide_rows(
        spark,
        [
            ("a", "n", "1", None), ("a", " n ", " 2 ", None), ("a", "n", None, None), ("a", "d", "1.5", None), ("a", "d", "", None), ("a", "s", '"x y"', None), ("a", "t", "2020-07-01 12:00:00", "berlin"),
            ("b", "n", "９", None), ("b", "d", "-.5e2", None), ("b", "s", "", None), ("b", "t", "never", "dump"), ("b", "other", "1", None), ("b", "variable", "7", None), ("b", "N", "2", None),
            ("c", "other", "x", None), ("c", None, "x", None), (None, "n", "1", None), ("d", "n", None, None),
            ("e", "n", "9223372036854775807", None), ("f", "n", "9223372036854775808", None), ("g", "n", "-0009223372036854775808", None), ("h", "d", "1e999", None), ("i", "d", "NaN", None), ("j", "t", "2020-07-01 12:00:00", None),
            ("k", "n", "1" * 5000, None), ("l", "s", "'", None),
        ],
    )
    assert out.columns == ["variable", "N", "d", "n_2", "s", "t", "unused", "variable_2", "unfit"]
    assert dict(out.dtypes)["n_2"] == "bigint" and dict(out.dtypes)["d"] == "double" and dict(out.dtypes)["t"] == "bigint"
    assert (got["a"]["n_2"], got["a"]["d"], got["a"]["s"], got["a"]["t"], got["a"]["unfit"]) == (2, None, "x y", us(2020, 7, 1, 10), ["d"])
    assert (got["b"]["n_2"], got["b"]["d"], got["b"]["s"], got["b"]["t"], got["b"]["variable_2"], got["b"]["N"]) == (None, -50.0, "", None, 7, 2.0)
    assert got["b"]["unfit"] == ["n", "t"]
    assert set(got) == set("abcdefghijkl") and all(v is None for k, v in got["c"].items() if k not in ("variable", "unfit")) and got["c"]["unfit"] == []
    assert got["e"]["n_2"] == 2**63 - 1 and got["f"]["unfit"] == ["n"] and got["g"]["n_2"] == -(2**63) and got["h"]["unfit"] == ["d"] and got["i"]["unfit"] == ["d"] and got["j"]["unfit"] == ["t"] and got["k"]["unfit"] == ["n"]
    assert got["l"]["s"] == "'"


def test_ties_skew_and_empty_tables(spark):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.4 else f"v{r.randrange(200)}", r.choice("nds"), r.choice(["1", "2.5", "x", None])) for _ in range(4000)]
    df = spark.createDataFrame([(i // 2, v, k, x, None, None) for i, (v, k, x) in enumerate(rows)], PROPS)
    got = {x["variable"]: x for x in wide.widen(df, {"n": "long", "d": "double", "s": "string"}).collect()}
    for variable in {v for v, _, _ in rows}:
        bad = []
        for key in "dns":
            said = [(i // 2, x) for i, (v, k, x) in enumerate(rows) if (v, k) == (variable, key) and x is not None]
            text = max(said)[1] if said else None
            value = {"s": lambda t: t, "n": lambda t: int(t) if t.isdigit() else None, "d": lambda t: float(t) if t[0].isdigit() else None}[key](text) if text else None
            assert got[variable][key] == value
            if text is not None and value is None:
                bad.append(key)
        assert got[variable]["unfit"] == bad
    assert wide.widen(df.limit(0), DECLARED).columns[-1] == "unfit" and wide.widen(df.limit(0), DECLARED).count() == 0
    assert wide.widen(df, {}).columns == ["variable", "unfit"]
    with pytest.raises(ValueError):
        wide.widen(df, {"n": "decimal"})


def strict_fields(line, sep):
    """Fields of a line by the rules of the format, None if its quotes break them."""
    line = line[:-1] if line.endswith("\r") else line
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return None
                if line[j : j + 2] == '""':
                    j += 2
                    continue
                break
            out.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < len(line) and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j].strip(" \t"))
            i = j
        if i >= len(line):
            return out
        i += 1
        if i == len(line):
            out.append("")
            return out


def strict_lsqb(line):
    fields = strict_fields(line, ",")
    if fields is None or len(fields) != 8:
        return False
    c1, _, c3, c4, c5, c6, c7, c8 = fields
    number = r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
    return bool(c1 and re.fullmatch("[0-9]+", c3) and int(c3) > 0 and re.fullmatch("[1-9]", c4) and re.fullmatch(number, c5) and re.fullmatch("[0-9]+", c6) and re.fullmatch("[0-9]+", c7) and re.fullmatch(rejects.PATTERN, c8))


def strict_neo4j(line):
    fields = strict_fields(line, "\t")
    if fields is None or len(fields) != 3:
        return False
    return bool(re.fullmatch("[0-9]+", fields[0]) and int(fields[0]) > 0 and re.fullmatch("[0-9]+|NC", fields[1]) and re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", fields[2]))


@pytest.mark.parametrize(("name", "form", "strict"), [("lsqb_lines", rejects.LSQB_RESULTS, strict_lsqb), ("neo4j_lines", rejects.NEO4J_RESULTS, strict_neo4j)])
def test_lines_of_the_tables(spark, sf, name, form, strict):
    rows = rejects.load_lines(spark.read.parquet(f"{sf}/{name}.parquet"), form).collect()
    assert rows and all((r["reason"] is None) == strict(r["raw"]) for r in rows if r["raw"] is not None)


P = "(?a:X)-[?e:T]->(Q5)"


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (f"S,v,1,2,0.5,10,3,{P}", None), (f'"S ""x""","a,b",1,2,1e-3,10,3,"{P}, {P} WHERE (?a.n >= 3) AND (?e = ""x"")"\r', None), (f" S , , 1 ,2,5 ,0,0, {P} ", None), (f'S,"two\nlines",1,2,0.5,10,3,{P}', None),
        (f",v,1,2,0.5,10,3,{P}", "c1: not system, not empty"), (f'"",v,1,2,0.5,10,3,{P}', "c1: not system, not empty"), (f"S,v,0,2,0.5,10,3,{P}", "c3: not integer above 0"), (f"S,v,1,0,0.5,10,3,{P}", "c4: not one digit 1-9"),
        (f"S,v,1,2,.5,10,3,{P}", "c5: not decimal number"), (f"S,v,1,2,-0.5,10,3,{P}", "c5: not decimal number"), (f"S,v,1,2,0.5,+10,3,{P}", "c6: not integer without sign"), (f"S,v,1,2,0.5,10,１,{P}", "c7: not integer without sign"),
        (f'S,v,1,2,0.5,10," 3",{P}', "c7: not integer without sign"), ("S,v,1,2,0.5,10,3,(?a)<-[?e]-(?b)", "c8: not pattern"), ('S,v,1,2,0.5,10,3,"(?a)-[?e]->(?b) WHERE ?a = 1"', "c8: not pattern"),
        (f"S,v,1,2,0.5,10,{P}", "missing columns"), (f"S,v,1,2,0.5,10,3,4,{P}", "too many columns"), ("", "missing columns"), (None, "no line"), ('"S,v,1', "broken quoting"), (f'S,v"w,1,2,0.5,10,3,{P}', "broken quoting"),
        (f'"S" ,v,1,2,0.5,10,3,{P}', "broken quoting"), (f"S,{'v' * 3_000_000},1,2,0.5,10,3,{P}", None), (f"S,v,99999999999999999999,2,0.5,10,3,{P}", None),
    ],
)
def test_single_lines(spark, line, reason):
    form = rejects.LSQB_RESULTS
    reader = rejects.LineReader(form)
    rows, wrong = reader.read([f"S,v,1,2,0.5,10,3,{P}", line, '"', line, f"S,v,1,2,0.5,10,3,{P}"])
    reasons = {r["__i"]: r["reason"] for r in rows.to_pylist()} | wrong
    assert [reasons[i] for i in range(5)] == [None, reason, "broken quoting", reason, None]
    if line:
        assert strict_lsqb(line) == (reason is None)


def test_casts_are_told_by_the_reject_table_and_long_counts_stay_valid():
    reader = rejects.LineReader(rejects.LSQB_RESULTS)
    lines = [f"S,v,x,2,0.5,10,3,{P}", f"S,v,1,2,0.5,{'9' * 30},3,{P}", f"S,v,1,2,0.5,1e3,3,{P}", f'S,v,1,"2",0.5,10,,{P}', f"S,v,1,2,nan,{'9' * 30},3,{P}", f"S,v,1,2,1e999,10,3,{P}", f'S,v,"0{7}",2,0.5,10,3,"(?a)"']
    rows, wrong = reader.read(lines)
    got = {r["__i"]: r for r in rows.to_pylist()}
    assert wrong == {0: "c3: not integer above 0", 2: "c6: not integer without sign", 3: "c7: not integer without sign", 4: "c5: not decimal number"}
    assert (got[1]["c3"], got[1]["c6"], got[1]["c7"], got[1]["reason"]) == (1, None, 3, None)
    assert got[5]["reason"] is None and got[6]["reason"] == "c8: not pattern"


def test_many_columns_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(wide, "GRID_CELLS", 6)
    rows = [(f"e{i % 23}", f"k{i % 5}", str(i), i) for i in range(200)]
    out = wide.widen(spark.createDataFrame(rows, "variable string, key string, value string, prop_id long"), {f"k{i}": "long" for i in range(5)}).collect()
    want = {(f"e{i % 23}", f"k{i % 5}"): i for i in range(200)}
    assert len(out) == 23 and {(r["variable"], k): r[k] for r in out for k in (f"k{i}" for i in range(5)) if r[k] is not None} == want


def test_jvm_reads_as_python_does(spark):
    r = random.Random(3)
    texts = []
    for _ in range(400):
        y, m, d = r.choice([0, 1, 44, 1899, 1969, 2000, 2024, 9999]), r.randint(0, 13), r.randint(0, 32)
        tail = r.choice(["Z", "+05:30", "-0330", "+14", "+19:00", "-18:59", "+05:60", ""])
        texts.append(f"{r.choice(['', '+', '-'])}{y:04d}-{m:02d}-{d:02d}{r.choice('T ')}{r.randint(0, 24):02d}:{r.randint(0, 60):02d}:{r.randint(0, 60):02d}{r.choice(['', '.5', '.123456789'])}{tail}")
    texts += [f"ZONED_DATETIME('{t}')" for t in texts[:60]] + ["0", "-5", "+1431006210000", "9" * 13, "1" * 14, "", "x", None, "2020-02-30T00:00:00Z", "２０２０-01-01T00:00:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {x["i"]: (x["r"]["instant"], x["r"]["local"], x["r"]["explicit"]) for x in df.select("i", instants.read_times(F.col("t"), F.lit("Europe/Berlin"), ZONES).alias("r")).collect()}
    abbr = instants.abbreviations(ZONES)
    assert [(texts[i], got[i]) for i in range(len(texts))] == [(t, instants.parse_instant(t, "Europe/Berlin", abbr)) for t in texts]


def test_any_character_survives(spark):
    odd = "x\ue000y\ue001z\nw\r\ue002"
    df = spark.createDataFrame([(1, f'S,"{odd}",7,2,1,10,3,{P}')], "line_id long, line string")
    assert rejects.load_lines(df, rejects.LSQB_RESULTS).head()["c2"] == odd


def test_typed_rows_and_kept_columns(spark):
    df = spark.createDataFrame([(1, f'S,"two\nlines\r",7,2,1.5e1,10,3,{P}', "f"), (1, f'S,"two\nlines\r",7,2,1.5e1,10,3,{P}', "f"), (2, "x", None)], "line_id long, line string, other string")
    loaded = rejects.load_lines(df, rejects.LSQB_RESULTS, keep=["line_id", "other"])
    rows = rejects.valid_rows(loaded).collect()
    assert len(rows) == 2 and (rows[0]["c2"], rows[0]["c3"], rows[0]["c5"], rows[0]["other"]) == ("two\nlines\r", 7, 15.0, "f")
    (bad,) = rejects.rejected_rows(loaded, rejects.LSQB_RESULTS).collect()
    assert (bad["line_id"], bad["raw"], bad["reason"]) == (2, "x", "missing columns")
    assert rejects.load_lines(df.limit(0), rejects.LSQB_RESULTS).count() == 0
    with pytest.raises(ValueError):
        rejects.load_lines(df.withColumnRenamed("other", "C1"), rejects.LSQB_RESULTS, keep=["C1"])


ABBR = instants.abbreviations({**ZONES, "isles": "Europe/London", "s": "Australia/Sydney", "k": "Asia/Kolkata", "t": "Asia/Tokyo", "m": "America/Chicago"})


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2015-05-07T15:43:30+02:00", None, us(2015, 5, 7, 13, 43, 30)), ("2015-05-07T15:43:30+0200", None, us(2015, 5, 7, 13, 43, 30)), ("+2015-05-07T15:43:30Z", "Asia/Tokyo", us(2015, 5, 7, 15, 43, 30)),
        ("2015-05-07 15:43:30.5", "Europe/Berlin", us(2015, 5, 7, 13, 43, 30, 500000)), ("2015-05-07T15:43:30.1234567", "UTC", us(2015, 5, 7, 15, 43, 30, 123456)), ("2015-05-07 15:43:30", None, None),
        ("1431006210", None, 1431006210 * 10**6), ("1431006210000", None, 1431006210 * 10**6), ("-5", None, -5 * 10**6), ("0", None, 0), ("1" * 25, None, None),
        ("ZONED_DATETIME('2015-05-07T15:43:30+05:30')", None, us(2015, 5, 7, 10, 13, 30)), ("20150507T154330Z", None, us(2015, 5, 7, 15, 43, 30)),
        ("07.05.2015 15:43:30", "UTC", us(2015, 5, 7, 15, 43, 30)), ("5/7/2015 3:43:30 PM", "UTC", us(2015, 5, 7, 15, 43, 30)), ("5/7/2015 12:43:30 AM", "UTC", us(2015, 5, 7, 0, 43, 30)), ("5/7/2015 13:43:30 PM", "UTC", None),
        ("Thu, 07 May 2015 15:43:30 +0200", None, us(2015, 5, 7, 13, 43, 30)), ("May 7, 2015 3:43:30 PM EDT", None, us(2015, 5, 7, 19, 43, 30)), ("2015-05-07 15:43:30 IST", None, us(2015, 5, 7, 10, 13, 30)), ("2015-05-07 15:43:30 XYZ", "UTC", None),
        ("2015-05-07T15:43:30[Europe/Berlin]", None, us(2015, 5, 7, 13, 43, 30)), ("2015-05-07T15:43:30+00:00[UTC]", None, us(2015, 5, 7, 15, 43, 30)), ("2015-05-07T15:43:30[Mars/Base]", None, None),
        ("2021-10-31 02:30:00", "Europe/Berlin", us(2021, 10, 31, 0, 30)), ("2021-10-31 02:30:00 CET", None, us(2021, 10, 31, 1, 30)), ("2021-10-31T02:30:00+01:00[Europe/Berlin]", None, us(2021, 10, 31, 1, 30)),
        ("2021-03-28 02:30:00", "Europe/Berlin", None), ("2021-03-28T02:30:00[Europe/Berlin]", None, None), ("2021-10-31T02:30:00[Europe/Berlin]", None, us(2021, 10, 31, 0, 30)),
        ("1990-00-00T00:00:00Z", None, us(1990, 1, 1)), ("2019-02-29T00:00:00Z", None, None), ("2020-02-29T00:00:00Z", None, us(2020, 2, 29)), ("2020-13-01T00:00:00Z", None, None), ("2020-01-01T24:00:00Z", None, None), ("2020-01-01T00:60:00Z", None, None),
        ("T12:00:00Z", None, None), ("circa 1900", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("n/a", "UTC", None), ("x" * 100_000, "UTC", None), ("2015-05-07T15:43:30-00:00", None, us(2015, 5, 7, 15, 43, 30)),
    ],
)
def test_instants(text, zone, want):
    assert instants.parse_instant(text, zone, ABBR)[0] == want


def test_years_before_one():
    a = instants.parse_instant("-0044-03-15T00:00:00Z", None, ABBR)[0]
    b = instants.parse_instant("ZONED_DATETIME('-0044-03-15T02:00:00+02:00')", None, ABBR)[0]
    later = instants.parse_instant("0001-01-01T00:00:00Z", None, ABBR)[0]
    assert a == b < later == us(1, 1, 1)
    assert (later - instants.parse_instant("0000-01-01T00:00:00Z", None, ABBR)[0]) == 366 * 86400 * 10**6
    assert instants.parse_instant("0001-01-01T00:00:00", "Asia/Tokyo", ABBR)[0] is not None


def test_zones_are_found_by_alignment(spark):
    r = random.Random(7)
    rows = []
    for source, zone in (("x", "America/New_York"), ("y", "Europe/Berlin"), ("z", "UTC"), (None, "UTC")):
        for _ in range(60):
            utc = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=r.randrange(365 * 86400))
            local = utc.astimezone(instants.zone_of(zone)).replace(tzinfo=timezone.utc)
            rows.append((source, int(local.timestamp()) * 10**6, int(utc.timestamp()) * 10**6))
    rows += [("x", None, 5), ("y", 5, None)]
    df = spark.createDataFrame(rows, "source string, local long, anchor long")
    zones = ["UTC", "Europe/Berlin", "America/New_York", "America/Chicago", "Asia/Tokyo", "Europe/London"]
    got = {x["source"]: (x["zone"], x["n_violations"]) for x in instants.estimate_zones(df, "source", "local", "anchor", zones).collect()}
    assert got == {"x": ("America/New_York", 0), "y": ("Europe/Berlin", 0), "z": ("UTC", 0)}
    ingest = df.withColumn("anchor", F.col("anchor") + 1)
    got = {x["source"]: x["n_violations"] for x in instants.estimate_zones(ingest, "source", "local", "anchor", zones, relation="before").collect()}
    assert got == {"x": 0, "y": 0, "z": 0}
    few = instants.estimate_zones(df.filter("source = 'x'").limit(3), "source", "local", "anchor", zones).collect()
    assert [(x["zone"], x["reason"]) for x in few] == [(None, "lead too small")]
    unsure = instants.estimate_zones(df.limit(0).union(spark.createDataFrame([("w", 0, 1)], df.schema)), "source", "local", "anchor", zones).collect()
    assert [(x["source"], x["zone"]) for x in unsure] == [("w", None)]
    assert instants.estimate_zones(df.limit(0), "source", "local", "anchor", zones).count() == 0


def test_instant_column(spark):
    df = spark.createDataFrame([("2021-07-01 12:00:00", "berlin"), ("2021-07-01 12:00:00", None), ("2021-07-01 12:00:00", "unknown"), (None, "berlin")], "v string, f string")
    got = [r[0] for r in df.select(instants.to_instant(F.col("v"), F.col("f"), ZONES)).collect()]
    assert got == [us(2021, 7, 1, 10), None, None, None]
    assert math.isclose(got[0], us(2021, 7, 1, 10))
