"""Evaluation texts, or passages of them, inside training text.

A prefix-filtered set join.  Texts are brought to the form of :mod:`graphloom.llm.looks`, lowered and cut
into words; a passage of ``words`` words is a window of consecutive ``shingle``-word shingles.

* The items' shingles are written as a table.  Their keys set the bits of a filter of bounded size, which is all that
  tasks over the corpus get to know of the items, however many there are.
* The corpus is read once.  Tasks keep the runs of shingles that may be an item's and that are long
  enough to hold a whole window (length bound), and count in how many documents each such shingle occurs.
* Shingles are ordered by rarity over the whole corpus.  A window needs all of its shingles, so its rarest one is a
  sufficient prefix; windows with a shingle that no document holds drop out.
* Runs are joined with windows on the prefix shingle in a shuffle, salted by document.  The place of the prefix
  in the window fixes where the window would have to lie (positional bound), and the window is compared there word by
  word, so neither the filter nor a collision of keys can add or lose a leak.

Defined results: null and empty texts and texts of fewer than ``words`` words leak nothing; repeated
documents and items are each reported; a document without an id is reported with a null one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from graphloom.llm.looks import Rewriter, rewriting
from graphloom.session import cut_lineage, spread

WORDS = 12
SHINGLE = 5
#: Bits of a key filter: about sixteen a key, within these bounds (at most 16 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
SALTS = 16
_WORD = re.compile(r"[^\W_]+")
_SPACED = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Documents whose shingles are made at once, and word hashes and counts that a task keeps.
AT_ONCE, KEPT = 512, 1 << 20


def words_of(text: str, rewriter: Rewriter) -> list[str]:
    """Maximal runs of letters and digits of the text's consistent form in lower case."""
    low = rewriter.form(text).lower()
    return low.translate(_SPACED).split() if low.isascii() else _WORD.findall(low)


class _Hashes(dict):
    """Word to a 64-bit hash that is the same in every task; 0 is no word."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return value


def _keys(ids: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit key of each run of ``shingle`` word hashes."""
    n = len(ids) - shingle + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(shingle):
        key = (key ^ ids[i : i + n]) * _MULTIPLIER
        key ^= key >> np.uint64(29)
    return key


class KeyFilter:
    """A bit set with two bits a key: tells keys that are surely not in the set."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def places(key, mask):
        return key & mask, (key >> np.uint64(32)) & mask

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        held = np.ones(len(keys), bool)
        for place in self.places(keys, self.mask):
            held &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return held


def key_filter(keys: DataFrame, column: str, least: int = LEAST_BITS, most: int = MOST_BITS) -> KeyFilter:
    """The filter of a LONG column.  Bits are put together by partial aggregates; at most ``most`` bits reach the driver."""
    bits = least
    wanted = 16 * keys.count()
    while bits < min(wanted, most):
        bits *= 2
    key = F.col(column)
    place = F.explode(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))).alias("place")
    # shifting takes the lowest six bits of the place as the bit within its word
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    for part in words.toArrow().to_batches():
        out[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
    return KeyFilter(out)


def _item_shingles(mapping: dict[str, str], words: int, shingle: int):
    """Every shingle of an item, with the words of the window that starts there (null where none does)."""

    def run(batches):
        rewriter, hashes = Rewriter(mapping), _Hashes()
        for batch in batches:
            row, item, at, key, text = [], [], [], [], []
            for number, own, value in zip(*(c.to_pylist() for c in batch.columns)):
                parts = words_of(value, rewriter) if value else []
                if len(parts) < words:
                    continue
                found = _keys(np.array([hashes[w] for w in parts], np.uint64), shingle)
                row += [number] * len(found)
                item += [own] * len(found)
                at += range(len(found))
                key.append(found.view(np.int64))
                text += [" ".join(parts[i : i + words]) if i + words <= len(parts) else None for i in range(len(found))]
            keys = np.concatenate(key) if key else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(item, pa.int64()), pa.array(at, pa.int32()), pa.array(keys), pa.array(text, pa.string())], names=["row", "item", "at", "key", "text"])

    return run


def _runs(found: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of at least ``least`` marked places."""
    marked = np.r_[False, found, False]
    edge = np.flatnonzero(marked[1:] != marked[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


_MARKED = "doc long, start int, keys array<bigint>, words array<string>, counts array<bigint>"


def _mark(filtering, mapping: dict[str, str], span: int, shingle: int):
    """Long runs of each document, with their words, and the document counts of what the task has met."""

    def run(batches):
        held = filtering.value
        rewriter, hashes = Rewriter(mapping), _Hashes()
        schema = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
        seen_key, seen_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        gap = [0] * shingle

        def counts():
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([seen_key.view(np.int64)], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.string())), pa.array([seen_n], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            docs, starts, kept, said = [], [], [], []
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), AT_ONCE):
                ids: list[int] = []
                owner, begin, spoken = [], [], []
                for name, text in zip(names[first : first + AT_ONCE], texts[first : first + AT_ONCE]):
                    if text:
                        own = words_of(text, rewriter)
                        owner.append(name)
                        begin.append(len(ids))
                        spoken.append(own)
                        ids.extend([hashes[w] for w in own])
                        ids.extend(gap)
                numbers = np.array(ids, np.uint64)
                keys = _keys(numbers, shingle)
                found = held.may_hold(keys)
                for i in range(shingle):
                    found &= numbers[i : i + len(keys)] > 0
                spots = np.flatnonzero(found)
                if len(hashes) > KEPT:
                    hashes.clear()
                if not len(spots):
                    continue
                doc_of = np.searchsorted(np.array(begin), spots, "right") - 1
                order = np.lexsort((doc_of, keys[spots]))
                key, doc_of = keys[spots][order], doc_of[order]
                once = np.r_[True, (key[1:] != key[:-1]) | (doc_of[1:] != doc_of[:-1])]
                seen_key, place = np.unique(np.concatenate([seen_key, key[once]]), return_inverse=True)
                seen_n = np.bincount(place, weights=np.concatenate([seen_n, np.ones(int(once.sum()))])).astype(np.int64)
                for a, b in zip(*_runs(found, span)):
                    at = np.searchsorted(begin, a, "right") - 1
                    docs.append(owner[at])
                    starts.append(a - begin[at])
                    kept.append(keys[a:b].view(np.int64))
                    said.append(spoken[at][a - begin[at] : b - begin[at] + shingle - 1])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(kept, pa.list_(pa.int64())), pa.array(said, pa.list_(pa.string())), pa.nulls(len(docs), pa.list_(pa.int64()))], schema=schema)
            if len(seen_key) > KEPT:
                yield counts()
                seen_key, seen_n = seen_key[:0], seen_n[:0]
        if len(seen_key):
            yield counts()

    return run


def _prefix_tokens(filtering, span: int, words: int):
    """The places of runs that may be a prefix, with the words around each that a window could take."""

    def run(batches):
        held = filtering.value
        for batch in batches:
            key, doc, doc_at, left, around = [], [], [], [], []
            for name, start, keys, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for spot in np.flatnonzero(held.may_hold(np.array(keys, np.int64).view(np.uint64))).tolist():
                    begin = max(0, spot - span + 1)
                    key.append(keys[spot])
                    doc.append(name)
                    doc_at.append(start + spot)
                    left.append(spot - begin)
                    around.append(own[begin : spot + words])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(doc_at, pa.int32()), pa.array(left, pa.int32()), pa.array(around, pa.list_(pa.string()))], names=["key", "doc", "doc_at", "left", "around"]
            )

    return run


def leaked_windows(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = WORDS, shingle: int = SHINGLE, most_bits: int = MOST_BITS, salts: int = SALTS) -> DataFrame:
    """``(doc, item, item_at, doc_at)``: every window of an item and every place of a document where it stands.

    Both ids are whole numbers.  Positions count words.
    """
    if not 1 <= shingle <= words:
        raise ValueError("a window holds at least one shingle")
    context, mapping, span = docs.sparkSession.sparkContext, rewriting(), words - shingle + 1
    least = min(LEAST_BITS, most_bits)
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    shingles = cut_lineage(asked.mapInArrow(_item_shingles(mapping, words, shingle), "row long, item long, at int, key long, text string"))
    known = context.broadcast(key_filter(shingles, "key", least, most_bits))
    rows = spread(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")), "doc")
    marked = cut_lineage(rows.mapInArrow(_mark(known, mapping, span, shingle), _MARKED))

    counts = marked.filter("counts IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("c")).groupBy(F.col("c.keys").alias("key")).agg(F.sum("c.counts").alias("n"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    rated = shingles.select("*", salt("row")).join(counts.select("*", every), ["key", "salt"], "left")
    ahead = Window.partitionBy("row").orderBy("at").rowsBetween(0, span - 1)  # the words of one item
    rated = rated.withColumn("first", F.min(F.struct("n", "key", "at")).over(ahead)).withColumn("alive", F.count("n").over(ahead) == span)
    # one row a window of an item that the corpus may hold
    windows = cut_lineage(rated.filter("alive AND text IS NOT NULL").select(F.col("first.key").alias("key"), (F.col("first.at") - F.col("at")).alias("place"), "item", F.col("at").alias("item_at"), "text"))
    prefixes = context.broadcast(key_filter(windows, "key", least, most_bits))
    tokens = marked.filter("counts IS NULL").select("doc", "start", "keys", "words").mapInArrow(_prefix_tokens(prefixes, span, words), "key long, doc long, doc_at int, left int, around array<string>")

    both = tokens.select("*", salt("doc")).join(windows.select("*", every), ["key", "salt"])
    begin = F.col("left") - F.col("place")
    there = (begin >= 0) & (begin + words <= F.size("around"))
    same = F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.lit(words)), " ") == F.col("text")
    return both.filter(there & same).select("doc", "item", "item_at", (F.col("doc_at") - F.col("place")).alias("doc_at"))
