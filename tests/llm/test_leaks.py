import random
import re

import pytest

from graphloom.llm import leaks, looks

PLAIN = looks.Rewriter(looks.rewriting())


def brute(docs, items, words):
    cut = lambda t: re.findall(r"[^\W_]+", PLAIN.form(t).lower()) if t else []
    out = set()
    for d, text in docs:
        own = cut(text)
        for i, item in items:
            theirs = cut(item)
            for a in range(len(theirs) - words + 1):
                for b in range(len(own) - words + 1):
                    if theirs[a : a + words] == own[b : b + words]:
                        out.add((d, i, a, b))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def sample(seed, vocabulary=30):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    items = [(i, " ".join(word() for _ in range(r.randint(3, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            at = r.randrange(len(text) + 1)
            text[at:at] = w[a : a + r.randint(4, 20)]
        docs.append((d, r.choice([" ", "_", ", ", "\n"]).join(text).replace("w1", r.choice(["w1", "W1", "ｗ1", "w​1"]))))
    return docs + [(100, None), (101, ""), (102, docs[3][1])], items + [(50, None), (51, ""), (52, items[2][1])]


@pytest.mark.parametrize(("seed", "words", "shingle", "vocabulary"), [(1, 12, 5, 30), (2, 6, 3, 4), (3, 5, 5, 3), (4, 12, 5, 2)])
def test_against_all_windows(spark, seed, words, shingle, vocabulary):
    docs, items = sample(seed, vocabulary)
    want = brute(docs, items, words)
    assert want
    for bits in (leaks.MOST_BITS, 64):  # a filter that lets everything through changes nothing
        got = leaks.leaked_windows(*frames(spark, docs, items), words=words, shingle=shingle, most_bits=bits, salts=3).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_documents_without_an_id(spark):
    docs, items = sample(1)
    docs = [(None if d % 7 == 0 else d, text) for d, text in docs]
    want = brute(docs, items, 6)
    got = leaks.leaked_windows(*frames(spark, docs, items), words=6, shingle=3).collect()
    assert any(d is None for d, *_ in want) and {tuple(r) for r in got} == want


def test_words():
    assert leaks.words_of("Don't_STOP – 3.5", PLAIN) == ["don", "t", "stop", "3", "5"]
    assert leaks.words_of("ＡＢＣ а_ÄÖ", PLAIN) == ["abc", "a", "äö"]


def test_key_collisions_are_resolved(spark, monkeypatch):
    docs, items = sample(5)
    made = leaks._keys
    monkeypatch.setattr(leaks, "_keys", lambda ids, shingle: made(ids, shingle) % 7)
    got = leaks.leaked_windows(*frames(spark, docs, items), words=6, shingle=3).collect()
    assert {tuple(r) for r in got} == brute(docs, items, 6)


def test_counts_are_handed_on_in_pieces(spark, monkeypatch):
    docs, items = sample(6)
    monkeypatch.setattr(leaks, "KEPT", 5)
    monkeypatch.setattr(leaks, "AT_ONCE", 3)
    got = leaks.leaked_windows(*frames(spark, docs, items), words=6, shingle=3).collect()
    assert {tuple(r) for r in got} == brute(docs, items, 6)


def test_filters_hold_their_keys(spark):
    import numpy as np

    r = random.Random(8)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, (1 << 63) - 1]
    held = leaks.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 1 << 10, 1 << 16)
    assert held.may_hold(np.array(keys, np.int64).view(np.uint64)).all()
    other = np.array([r.randrange(1 << 63) for _ in range(3000)], np.uint64)
    assert held.may_hold(other).mean() < 0.05 and len(held.words) == 1 << 10


def test_nothing_to_find(spark):
    docs, items = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert leaks.leaked_windows(docs, items).count() == 0
    assert leaks.leaked_windows(docs.limit(0), items, words=3, shingle=2).count() == 0
    assert leaks.leaked_windows(docs, items.limit(0), words=3, shingle=2).count() == 0
    with pytest.raises(ValueError):
        leaks.leaked_windows(docs, items, words=3, shingle=5)


def test_very_long_text_and_shared_passages(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(i, ("filler " * 50_000 if i == 0 else "") + passage) for i in range(5)] + [(9, passage.replace("p10", "q"))]
    got = {(r["doc"], r["item"]) for r in leaks.leaked_windows(*frames(spark, docs, [(1, passage + " tail"), (2, "head " + passage)])).collect()}
    assert got == {(d, i) for d in range(5) for i in (1, 2)}
