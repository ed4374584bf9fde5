from collections import defaultdict
from itertools import combinations

import duckdb
import pytest

from graphloom.llm import leaks, looks, queries


def texts(spark, sf, name, key):
    return {r[key]: r["text"] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()}


def test_leaks_of_the_tables(spark, sf):
    form = looks.Rewriter(looks.rewriting())
    windows = defaultdict(set)
    for item, text in texts(spark, sf, "eval_items", "item_id").items():
        own = leaks.words_of(text or "", form)
        for i in range(len(own) - 11):
            windows[tuple(own[i : i + 12])].add(item)
    want = defaultdict(set)
    for doc, text in texts(spark, sf, "documents", "doc_id").items():
        own = leaks.words_of(text or "", form)
        for i in range(len(own) - 11):
            for item in windows.get(tuple(own[i : i + 12]), ()):
                want[doc, item].add(tuple(own[i : i + 12]))
    assert want
    found = queries.p7_found(spark, sf)
    assert found.columns == ["doc_id", "item_id"]
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == set(want) and len(rows) == len(want)
    report = {(r["doc_id"], r["item_id"]): r for r in queries.p7_report(spark, sf).collect()}
    assert set(report) == set(want) and all(report[k]["n_windows"] >= len(v) for k, v in want.items())


def test_looks_of_the_tables(spark, sf):
    docs = {d: t for d, t in texts(spark, sf, "documents", "doc_id").items() if t}
    form = looks.Rewriter(looks.rewriting(looks.member_frequencies(spark.read.parquet(f"{sf}/documents.parquet"), "text")))
    classes = defaultdict(list)
    for d in sorted(docs):
        classes[form.form(docs[d])].append(d)
    want = {(a, b) for own in classes.values() for a, b in combinations(own, 2) if docs[a] != docs[b]}
    found = queries.p9_found(spark, sf)
    assert found.columns == ["doc_id_a", "doc_id_b"]
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    got = {r["doc_id"]: (r["class_id"], r["n_texts"]) for r in queries.p9_classes(spark, sf).collect()}
    assert got == {d: (own[0], len({docs[x] for x in own})) for own in classes.values() for d in own}


def test_mix_of_the_tables(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "mix_targets"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(queries.ORACLE["p8_quotas"]).fetchall())
    assert sorted(tuple(r) for r in queries.p8_quotas(spark, sf).collect()) == want
    mixed = queries.p8_mix(spark, sf).collect()
    shares = {r["source"]: r for r in queries.p8_shares(spark, sf).collect()}
    total = sum(r["n_tokens"] * r["copies"] for r in mixed)
    for source, row in shares.items():
        own = [r for r in mixed if r["source"] == source]
        assert row["mixed_tokens"] == sum(r["n_tokens"] * r["copies"] for r in own)
        assert row["actual_share"] == pytest.approx(row["mixed_tokens"] / total)
        assert all(1 <= r["copies"] <= (row["max_repeats"] or 0) for r in own)


def test_every_query_is_looked_at():
    assert set(queries.QUERIES) == {"p7_found", "p7_report", "p8_mix", "p8_shares", "p8_quotas", "p9_found", "p9_classes"}
