import heapq
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


def one_by_one(weights, seats, caps):
    """Sainte-Lague by its definition."""
    given_ = [0] * len(weights)
    queue = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given_[i] += 1
        if given_[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given_[i] + 1), i))
    return given_


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.floats(0.001, 1), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_apportionment(pairs, seats):
    weights, caps = [p[0] for p in pairs], [p[1] for p in pairs]
    assert mixing.sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)


def test_apportionment_of_very_many_seats():
    got = mixing.sainte_lague([0.5, 0.3, 0.2], 10**12, [10**13] * 3)
    assert got == [5 * 10**11, 3 * 10**11, 2 * 10**11]
    assert mixing.sainte_lague([1.0, 1.0], 10, [3, 100]) == [3, 7]
    assert mixing.sainte_lague([0.0, 1.0], 4, [9, 9]) == [0, 4] and mixing.sainte_lague([], 4, []) == []


DOCS = "doc_id long, text string, source string, SOURCE_NAME string"
TARGETS = "source string, target_share double, max_repeats int"


def docs_of(spark, seed=1, n=600):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("alpha beta gamma".split()) for _ in range(r.randint(1, 60))), r.choice(["big"] * 6 + [" BIG "] + ["mid"] * 2 + ["small"]), "x") for i in range(n)]
    return rows + [(n, None, "big", "x"), (n + 1, "", "mid", "x"), (n + 2, "no source", None, "x"), (n + 3, "strange", "unknown", "x")]


def test_shares_and_repeats(spark):
    rows = docs_of(spark)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    targets = spark.createDataFrame([("Big", 0.3, 1), ("mid ", 0.4, 3), ("small", 0.2, 4), ("gone", 0.1, 2)], TARGETS)
    mixed, report = mixing.mix(df, targets, shard_tokens=2000)
    picked = {r["doc_id"]: r for r in mixed.collect()}
    caps = {"big": 1, "mid": 3, "small": 4}
    assert len(picked) == mixed.count() and all(1 <= r["copies"] <= caps[r["source"]] for r in picked.values())
    assert not {600, 601, 602, 603} & set(picked)
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"big", "mid", "small", "gone", "unknown"}
    for name, share in (("big", 0.3), ("mid", 0.4), ("small", 0.2)):
        assert by[name]["mixed_tokens"] == sum(r["n_tokens"] * r["copies"] for r in picked.values() if r["source"] == name)
        assert by[name]["filled"] and 0 <= by[name]["quota_tokens"] - by[name]["mixed_tokens"] < 0.002 * by[name]["quota_tokens"]
        assert abs(by[name]["actual_share"] - share / 0.9) < 0.01 * share
    assert by["gone"]["mixed_tokens"] == by["unknown"]["mixed_tokens"] == 0 and by["unknown"]["target_share"] is None
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7), targets, shard_tokens=2000)[0].collect()}
    assert again == {k: r["copies"] for k, r in picked.items()}
    other = {r["doc_id"] for r in mixing.mix(df, targets, seed=5)[0].collect()}
    assert other != set(picked)


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize(("shard_tokens", "blocks", "repeats"), [(1 << 26, 100_000, 1), (2000, 100_000, 1), (2000, 100_000, 2), (1500, 5, 1), (500, 7, 4)])
def test_quota_is_filled_till_nothing_fits(spark, seed, shard_tokens, blocks, repeats):
    r = random.Random(seed)
    df = spark.createDataFrame([(i, "word " * r.randint(3, 200), "a", "x") for i in range(300)], DOCS).repartition(3)
    targets = spark.createDataFrame([("a", 1.0, repeats)], TARGETS)
    supply = mixing.mix(df, targets)[1].first()["available_tokens"]
    size = max(1, supply // blocks)
    for total in (supply // 3, supply * repeats * 9 // 10):
        mixed, report = mixing.mix(df, targets, total_tokens=total, shard_tokens=shard_tokens, blocks=blocks, seed=seed)
        copies = {x["doc_id"]: x["copies"] for x in mixed.collect()}
        left = total // size * size - report.first()["mixed_tokens"]
        sizes = {x["doc_id"]: x["n_tokens"] for x in mixing.token_sizes(df, "doc_id", "text").collect()}
        out = [n for i, n in sizes.items() if i not in copies] or [n for i, n in sizes.items() if copies[i] == min(copies.values())]
        assert 0 <= left < min(out) and max(copies.values()) <= repeats


def test_shards_stay_whole_when_a_join_is_planned_anew(spark):
    """A quota join that turns into a broadcast while running must not spread the rows of a shard."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.shuffle.partitions": "12"}
    kept = {k: spark.conf.get(k) for k in settings}
    df = spark.range(60_000).selectExpr("id as doc_id", "repeat('word ', int(1 + id % 9)) as text", "if(id % 3 = 0, 'a', 'b') as source").repartition(8)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], TARGETS)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        report = {r["source"]: r for r in mixing.mix(df, targets, total_tokens=150_000)[1].collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert 149_900 <= sum(r["mixed_tokens"] for r in report.values()) <= 150_000


def test_one_ordered_pass_takes_what_fits():
    r = random.Random(4)
    for _ in range(300):
        sizes, left = [r.randint(1, 40) for _ in range(r.randint(0, 60))], r.randint(0, 500)
        taken, rest = mixing.take_what_fits(mixing.np.array(sizes, "int64"), left)
        for n, got in zip(sizes, taken):
            assert got == (n <= left)
            left -= n * got
        assert rest == left


def test_used_up_sources_give_all_they_may(spark):
    df = spark.createDataFrame(docs_of(spark), DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    mixed, report = mixing.mix(df, targets, total_tokens=10_000)
    by = {r["source"]: r for r in report.collect()}
    assert by["small"]["mixed_tokens"] >= 0.97 * 2 * by["small"]["available_tokens"]
    total = sum(r["mixed_tokens"] for r in by.values())
    assert 0.97 * 10_000 <= total <= 10_000 * 1.01
    assert {r["copies"] for r in mixed.filter("source = 'small'").collect()} == {2}


def test_one_document_larger_than_a_block(spark):
    rows = [(1, "word " * 30_000, "a", "x"), (2, "word", "b", "x"), (3, "word " * 10, "b", "x")]
    mixed, report = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS))
    assert {r["source"] for r in report.collect()} == {"a", "b"} and all(r["copies"] <= 2 for r in mixed.collect())


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed, report = mixing.mix(docs, targets)
    assert mixed.count() == 0 and [r["mixed_tokens"] for r in report.collect()] == [0]
    assert mixing.mix(spark.createDataFrame(docs_of(spark, n=20), DOCS), targets.limit(0))[0].count() == 0


def test_sizes_are_those_of_the_tokenizer(spark):
    rows = [(1, "hello world, hello", "a", "x"), (2, None, "a", "x"), (3, "<|endoftext|> é", "a", "x")]
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.token_sizes(spark.createDataFrame(rows, DOCS), "doc_id", "text", ["source"]).collect()}
    assert got[1] == 4 and got[2] == 0 and got[3] > 2
