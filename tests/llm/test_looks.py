import random
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.llm import looks

PLAIN = looks.Rewriter(looks.rewriting())


@pytest.mark.parametrize(
    ("strange", "plain"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ！１２", "full width!12"), ("ﬁne ﬂow oﬃce", "fine flow office"), ("été", "été"), ("naïve", "naïve"), ("zero​width⁠ so­ft﻿", "zerowidth soft"),
        ("a b c　d e", "a b c d e"), ("раура1 СОРЕ", "paypa1 COPE"), ("οօо", "ooo"), ("Kelvin", "Kelvin"), ("ΑΒΕ", "ABE"), ("е́", "é"), ("e‍́", "é"), ("が", "が"), ("ｶﾞ", "ガ"), ("ｆﬁ", "ffi"), ("q̣̇", "q̣̇"),
    ],
)
def test_same_look(strange, plain):
    assert PLAIN.form(strange) == PLAIN.form(plain)


@pytest.mark.parametrize(("a", "b"), [("ete", "été"), ("a", "A"), ("1", "2"), ("O", "0"), ("l", "1"), ("a b", "a  b"), ("a\nb", "a b"), ("a\tb", "a b"), ("x²", "x2"), ("½", "1/2"), ("в", "B"), ("ж", "x"), ("ß", "ss"), ("…", "..."), ("rn", "m"), ("α", "a"), ("Ⅷ", "VIII"), ("ɡ", "g")])
def test_different_look(a, b):
    assert PLAIN.form(a) != PLAIN.form(b)


def test_classes_are_transitive_and_disjoint():
    classes = looks.look_alike_classes()
    members = [m for c in classes for m in c]
    assert len(members) == len(set(members))
    (of_o,) = [c for c in classes if "o" in c]
    assert {"о", "ο", "օ", "ｏ"} <= set(of_o)
    for strange, plain in looks.look_alike_pairs():
        assert PLAIN.form(strange) == PLAIN.form(plain)


def test_frequent_members_stand_for_their_class():
    often = looks.rewriting({"о": 10, "o": 3})
    assert often["o"] == "о" and "о" not in often
    rewriter = looks.Rewriter(often)
    assert rewriter.form("oоο") == "ооо" and rewriter.form("ﬁ") == rewriter.form("fi")
    assert looks.rewriting({"ﬁ": 1000})["ﬁ"] == "fi"


def test_forms_are_stable():
    r = random.Random(1)
    pool = [m for c in looks.look_alike_classes() for m in c if m] + list("abc \ń̈")
    for _ in range(300):
        text = "".join(r.choice(pool) for _ in range(r.randrange(12)))
        form = PLAIN.form(text)
        assert PLAIN.form(form) == form == unicodedata.normalize("NFC", form)


TEXTS = ["plain text", "plain text", "plаin text", "ｐlain text", "Plain text", "plain text", "other", None, "", "​", "⁠", "é" * 50_000, "é" * 50_000, "é" * 50_001]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, DOC_TEXT string").repartition(3)


def test_pairs_and_classes(spark):
    prints = looks.fingerprints(table(spark, TEXTS), "doc_id", "text")
    want = {(a, b) for (a, x), (b, y) in combinations(enumerate(TEXTS), 2) if x and y and x != y and PLAIN.form(x) == PLAIN.form(y)}
    assert {tuple(r) for r in looks.same_look_pairs(prints, "doc_id").collect()} == want
    classes = {r["doc_id"]: (r["class_id"], r["n_texts"]) for r in looks.look_classes(prints, "doc_id").collect()}
    assert set(classes) == {i for i, t in enumerate(TEXTS) if t}
    assert {classes[i] for i in (0, 1, 2, 3, 5)} == {(0, 4)} and classes[4] == (4, 1)


def test_texts_of_a_class_are_counted_exactly(spark):
    """Classes of two texts with a copy of one of them, of two texts that share half of their hash, and of very many texts."""
    n, many = 20_000, 30_000
    two = spark.range(3 * n).selectExpr("id as doc_id", "id div 3 as look_1", "1L as look_2", "xxhash64(if(id % 3 = 2, id - 1, id)) as text_1", "0L as text_2")
    half = spark.range(2).selectExpr("id + 1000000 as doc_id", "1L as look_1", "2L as look_2", "7L as text_1", "id as text_2")
    large = spark.range(many).selectExpr("id + 2000000 as doc_id", "1L as look_1", "3L as look_2", "xxhash64(id) as text_1", "xxhash64(id, 1) as text_2")
    got = looks.look_classes(two.union(half).union(large), "doc_id").groupBy("class_id", "n_texts").count().collect()
    assert len(got) == n + 2
    of = {r["class_id"]: (r["n_texts"], r["count"]) for r in got}
    assert of.pop(1000000) == (2, 2) and of.pop(2000000) == (many, many)
    assert set(of) == set(range(0, 3 * n, 3)) and set(of.values()) == {(2, 3)}


def test_many_copies_of_one_text(spark):
    texts = ["same"] * 600 + ["ѕame", "samе"]
    pairs = {tuple(r) for r in looks.same_look_pairs(looks.fingerprints(table(spark, texts), "doc_id", "text"), "doc_id").collect()}
    assert len(pairs) == 600 * 2 + 1 and (600, 601) in pairs and (0, 1) not in pairs


def test_normalise_keeps_other_columns(spark):
    df = table(spark, ["а b", None, ""])
    assert looks.normalise(df, "text").columns == df.columns
    rows = {r["doc_id"]: r for r in looks.normalise(df, "text", out="form", mapping=looks.rewriting()).collect()}
    assert (rows[0]["form"], rows[0]["text"], rows[1]["form"], rows[2]["form"]) == ("a b", "а b", None, "")
    with pytest.raises(ValueError):
        looks.normalise(df, "text", out="Text")
    assert looks.fingerprints(df.limit(0), "doc_id", "text").count() == 0
    assert looks.same_look_pairs(looks.fingerprints(df.limit(0), "doc_id", "text"), "doc_id").count() == 0


def test_frequencies_count_the_whole_table(spark):
    df = table(spark, ["aаa", "а o", None]).withColumn("text", F.col("text"))
    got = looks.member_frequencies(df, "text")
    assert (got["a"], got["а"], got["o"]) == (2, 2, 1) and "b" not in got
