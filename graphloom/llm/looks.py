"""One consistent form for text that looks the same but is written with different characters.

Look-alike classes are the components of a union-find over strings and code points.  Its pairs come
from rules over the Unicode character data (full- and half-width forms, ligatures, Roman numerals of one letter,
blanks of one word space, invisible characters) and from the table of look-alike letters below; so ``ﬁ``, ``fi`` and
``ｆｉ`` end in the same form.  Within a class of single characters the most frequent
one in the corpus stands for all; a class with the empty string vanishes; a ligature becomes its letters.
Text is decomposed, rewritten greedily (leftmost, longest) by an Aho-Corasick automaton over all other
members, and composed again, so composed and combining accents agree.

Other letters, other case, other digits, missing accents, line breaks, tabs and numbers of blanks stay
different.  Null text stays null, empty text empty; a text of invisible characters alone becomes empty.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spread

# Letters of other alphabets and, below each, the letters that they look like.
LOOK_ALIKES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴ", "ABESIJKMHOPCTYXYGQWIV"),
    ("аеѕіјорсухүһԁԛԝѵ", "aesijopcyxyhdqwv"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ", "ABEZHIKMNOPTYXCMJ"),
    ("ονρϲϳ", "ovpcj"),
    # Armenian
    ("ՕՍԼՏ", "OULS"),
    ("օսհոցզյ", "ouhngqj"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZWVSLCPK"),
    # Coptic
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "HIKMNOPCTYX"),
    ("ⲟⲣⲥ", "opc"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Deseret
    ("𐐄𐐕𐐛𐐠𐐬𐐽𐑈", "OCLSocs"),
)
#: Format characters that are drawn: number and verse signs set before other characters.
_DRAWN = set(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]))
#: Fillers that are drawn as nothing, though they count as letters or marks.
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def is_invisible(char: str) -> bool:
    code = ord(char)
    return (unicodedata.category(char) == "Cf" and char not in _DRAWN) or char in _FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F


def look_alike_pairs() -> Iterable[tuple[str, str]]:
    """Pairs of strings that look the same, in decomposed form."""
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if is_invisible(char):
            yield char, ""
        elif kind == "Zs":
            yield char, " "
        elif form := unicodedata.decomposition(char):
            tag, _, rest = form.partition(" ")
            name = unicodedata.name(char, "")
            if tag in ("<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and ("LIGATURE" in name or ("ROMAN NUMERAL" in name and " " not in rest))):
                yield char, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    for strange, plain in LOOK_ALIKES:
        yield from zip(strange, plain, strict=True)


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, item: str) -> str:
        self.parent.setdefault(item, item)
        root = item
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[item] != root:
            self.parent[item], item = root, self.parent[item]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    sets = UnionFind()
    for a, b in look_alike_pairs():
        sets.union(a, b)
    classes: dict[str, list[str]] = {}
    for item in sets.parent:
        classes.setdefault(sets.find(item), []).append(item)
    return tuple(sorted(tuple(sorted(c)) for c in classes.values()))


def rewriting(frequency: Mapping[str, int] | None = None) -> dict[str, str]:
    """Member to representative.  Without frequencies the lowest code point stands for its class."""
    frequency = frequency or {}
    chosen: dict[str, str] = {}
    for members in look_alike_classes():
        longest = max(members, key=len)
        stands = "" if "" in members else longest if len(longest) > 1 else min(members, key=lambda m: (-frequency.get(m, 0), m))
        chosen |= {m: stands for m in members if m != stands}
    single = {m: r for m, r in chosen.items() if len(m) == 1}
    return {m: "".join(single.get(c, c) for c in r) if len(r) > 1 else r for m, r in chosen.items() if m}


class Rewriter:
    """The automaton; built once per task from the mapping that travels with it."""

    def __init__(self, mapping: Mapping[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for member, stands in mapping.items():
            self.automaton.add_word(member, (len(member), stands))
        self.automaton.make_automaton()
        self.ascii_changes = any(m.isascii() for m in mapping)

    def form(self, text: str) -> str:
        if text.isascii() and not self.ascii_changes:
            return text
        text = unicodedata.normalize("NFD", text)
        parts, at = [], 0
        for end, (size, stands) in self.automaton.iter_long(text):
            parts.append(text[at : end + 1 - size])
            parts.append(stands)
            at = end + 1
        parts.append(text[at:])
        return unicodedata.normalize("NFC", "".join(parts))


def member_frequencies(df: DataFrame, text: str) -> dict[str, int]:
    """How often each single-character class member occurs in the whole corpus.

    Tasks count in fixed arrays; what is gathered is bounded by the number of class members.
    """
    members = sorted(m for c in look_alike_classes() for m in c if len(m) == 1)

    def count(batches):
        low = np.zeros(128, np.int64)
        high = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            column = batch.column(0)
            for value in column.drop_null().to_pylist():
                if value.isascii():
                    low += np.bincount(np.frombuffer(value.encode(), np.uint8), minlength=128)
                else:
                    codes = np.frombuffer(unicodedata.normalize("NFD", value).encode("utf-32-le", "surrogatepass"), np.uint32)
                    found, times = np.unique(codes, return_counts=True)
                    high[found] += times
        high[:128] += low
        there = [m for m in members if high[ord(m)]]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.string()), pa.array([int(high[ord(m)]) for m in there], pa.int64())], names=["member", "n"])

    counted = spread(df.select(F.col(f"`{text}`").cast("string").alias("text")), "text").mapInArrow(count, "member string, n long")
    return {r["member"]: int(r["n"]) for r in counted.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def _mapped(mapping: Mapping[str, str], make, schema: str):
    def run(batches):
        rewriter = Rewriter(mapping)
        for batch in batches:
            yield make(batch, rewriter)

    return run


def normalise(df: DataFrame, text: str, *, out: str | None = None, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with column ``text`` (or a new column ``out``) in the consistent form."""
    from pyspark.sql import types as T

    mapping = rewriting(member_frequencies(df, text)) if mapping is None else dict(mapping)
    if out and out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    struct = T.StructType([*df.schema.fields, *([T.StructField(out, T.StringType())] if out else [])])

    def make(batch, rewriter):
        at = batch.schema.get_field_index(text)
        formed = pa.array([None if v is None else rewriter.form(v) for v in batch.column(at).to_pylist()], batch.schema.field(at).type)
        columns = batch.columns
        names = list(batch.schema.names)
        if out:
            return pa.RecordBatch.from_arrays([*columns, formed], names=[*names, out])
        columns[at] = formed
        return pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(_mapped(mapping, make, ""), struct)


def fingerprints(df: DataFrame, key: str, text: str, *, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """``(key, look_1, look_2, text_1, text_2)``: 128-bit hashes of the form and of the text itself.

    Null and empty texts are left out.  No text leaves its task.
    """
    mapping = rewriting(member_frequencies(df, text)) if mapping is None else dict(mapping)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, look_1 long, look_2 long, text_1 long, text_2 long"

    def make(batch, rewriter):
        from xxhash import xxh3_128_digest

        keys, texts = batch.column(0), batch.column(1).to_pylist()
        there = [i for i, v in enumerate(texts) if v]
        own = [xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in there]
        look = []
        for i, digest in zip(there, own):
            formed = rewriter.form(texts[i])
            look.append(digest if formed == texts[i] else xxh3_128_digest(formed.encode("utf-8", "surrogatepass")))
        looks = np.frombuffer(b"".join(look), "<i8").reshape(-1, 2)
        texts_ = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
        arrays = [keys.take(pa.array(there, pa.int64())), *(pa.array(np.ascontiguousarray(a[:, i])) for a in (looks, texts_) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "look_1", "look_2", "text_1", "text_2"])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")), key).mapInArrow(_mapped(mapping, make, schema), schema)


LOOK = ["look_1", "look_2"]
SALTS = 8


def look_classes(prints: DataFrame, key: str) -> DataFrame:
    """Every row with its class: (key, class_id, n_texts); class_id is the smallest key that looks the same.

    ``n_texts`` is the exact number of different texts in the class; copies of a text are put together first.
    """
    per_text = prints.groupBy(*LOOK, "text_1", "text_2").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("rows"))
    per_class = per_text.groupBy(*LOOK).agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("rows").alias("rows"))
    # rows are salted, so a class of very many rows is spread; a class of one row needs no copies
    per_class = per_class.withColumn("salt", F.explode(F.when(F.col("rows") == 1, F.array(_salt("class_id"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return prints.select(key, *LOOK, _salt(key).alias("salt")).join(per_class, [*LOOK, "salt"]).select(key, "class_id", "n_texts")


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def same_look_pairs(prints: DataFrame, key: str) -> DataFrame:
    """Pairs of rows, smaller key first, whose texts differ but look the same.

    Pairs are found between distinct texts of a class first; rows come in only then, so a text with very
    many exact copies costs no comparison of copies with each other.  Rows of such a text are salted.
    """
    text = ["text_1", "text_2"]
    distinct = prints.groupBy(*LOOK, *text).agg(F.count(F.lit(1)).alias("n"))
    several = distinct.groupBy(*LOOK).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    distinct = distinct.join(several, LOOK, "left_semi")
    # only classes of several texts are left; one side is salted, the other repeated
    a = distinct.select(*LOOK, F.struct(*text).alias("text_a"), _salt(*text).alias("salt"))
    b = distinct.select(*LOOK, F.struct(*text).alias("text_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = a.join(b, [*LOOK, "salt"]).filter(F.col("text_a") < F.col("text_b")).drop(*LOOK, "salt")
    rows = prints.select(F.col(key).alias("__key"), F.struct(*text).alias("text"))
    salted = rows.withColumn("salt", _salt("__key"))
    pairs = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = pairs.join(salted.withColumnsRenamed({"text": "text_a", "__key": "key_a"}), ["text_a", "salt"]).drop("salt", "text_a")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = left.join(salted.withColumnsRenamed({"text": "text_b", "__key": "key_b"}), ["text_b", "salt"])
    return both.select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b"))
