"""Mix sources to target shares of all tokens.

Sizes are counted with a public tokenizer.  Tokens are dealt in equal blocks: Sainte-Lague
apportionment gives each next block to the source with the highest quotient ``share / (2 a + 1)``, and
within a source to its shards by the same rule, so every shard gets an integer quota.  Inside a shard
documents stand in a seeded order; a quota takes whole passes over the shard and then the first
blocks of that order, where documents are taken whole and the gap that the last one leaves is filled by
later ones that fit, till none of the shard fits.  What is left then of all shards of a source goes to its
smallest documents that are still out (the seeded order among equals), till none of the source fits.  A
document is taken at most ``max_repeats`` times, and at most once beyond the whole passes over its shard.

Without a wish for ``total_tokens`` the mix is as large as all shares allow.  Beyond that, sources that
are used up give all they may and the others fill the rest; the shares reached are reported.

Defined results: sources are matched without regard to case and outer blanks; a source that stands on one
side only takes no part, its share goes to the others in proportion; documents of null source or without
any token are left out; empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits text before its merges (a fixed value of the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 20240501
BLOCKS = 100_000
MOST_BLOCK_TOKENS = 65_536
SHARD_TOKENS = 1 << 26
MOST_TARGETS = 10_000


def source_key(column):
    return F.lower(F.trim(column))


def token_sizes(df: DataFrame, key: str, text: str, keep: Sequence[str] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, keep..., n_tokens)``; null text has no tokens."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *keep)), "n_tokens long"])

    def run(batches):
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[key, *keep, "n_tokens"])

    return spread(df.select(*[F.col(f"`{c}`") for c in (key, *keep)], F.col(f"`{text}`").cast("string").alias("__text")), key).mapInArrow(run, schema)


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients ``w / (2 a + 1)``, none beyond its cap; ties go to the first.

    All seats up to just below the last quotient are dealt at once by bisection, the rest one by one,
    so the cost does not grow with the number of seats.
    """
    w, cap = np.asarray(weights, float), np.asarray(caps, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def dealt(limit: float) -> np.ndarray:
        """Seats of each whose quotient is above ``limit``."""
        return np.minimum(cap, np.ceil(np.maximum(0.0, (w / limit - 1) / 2)).astype(np.int64))

    lo, hi = w.max() / (4.0 * seats + 4) / max(1.0, len(w)) * 1e-6, w.max() * 2
    for _ in range(200):
        middle = (lo * hi) ** 0.5
        if dealt(middle).sum() > seats:
            lo = middle
        else:
            hi = middle
    given = dealt(hi)
    queue = [(-x / (2 * a + 1), i) for i, (x, a) in enumerate(zip(w.tolist(), given.tolist())) if a < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(queue, (-w[i] / (2 * given[i] + 1), i))
    return given.tolist()


def take_what_fits(sizes: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """One pass in order that takes each size that fits into what is left: which are taken, and the rest."""
    taken = np.zeros(len(sizes), bool)
    at = np.flatnonzero(sizes <= left)
    while at.size:
        sums = np.cumsum(sizes[at])
        n = int(np.searchsorted(sums, left, "right"))
        taken[at[:n]] = True
        left -= int(sums[n - 1])
        at = at[n + 1 :]
        at = at[sizes[at] <= left]
    return taken, left


def fill(batches):
    """Shards whole and in order, ``nth`` counting their rows, with ``taken``; what is left of a shard's ``rest`` is carried along."""
    left, before = 0, -1
    for batch in batches:
        sizes, rests, nth = (batch.column(c).to_numpy() for c in ("n_tokens", "rest", "nth"))
        if len(nth) and not np.all((nth == 1) | (nth == np.append(before, nth[:-1]) + 1)):
            raise RuntimeError("a shard is not whole or not in order")
        taken = np.zeros(len(nth), bool)
        starts = sorted({0, *np.flatnonzero(nth == 1).tolist()})
        for a, b in zip(starts, [*starts[1:], len(nth)]) if len(nth) else ():
            left = int(rests[a]) if nth[a] == 1 else left
            taken[a:b], left = take_what_fits(sizes[a:b], left)
        before = int(nth[-1]) if len(nth) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken)], names=[*batch.schema.names, "taken"])


def mix(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The mix ``(doc_id, source, n_tokens, copies)`` and its report.

    The report has a row for each source of either side: ``(source, target_share, max_repeats,
    available_tokens, quota_tokens, mixed_tokens, actual_share, filled)``.  A quota is filled where no document that
    may still be taken fits into what is left of it.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{doc_id}`"), source_key(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text"))
    sizes = cut_lineage(token_sizes(named, doc_id, "text", ["source"], tokenizer))
    wanted = [(r[0], float(r[1]), int(r[2])) for r in targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(source_key(F.col("source")), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted.sort()
    names = [w[0] for w in wanted]
    # one row for each source that has a target
    have = {r[0]: int(r[1]) for r in sizes.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens")).collect()}
    used = [w for w in wanted if have.get(w[0], 0) > 0 and w[2] > 0]
    supply = sum(have[w[0]] for w in used)
    size = max(1, min(supply // blocks, MOST_BLOCK_TOKENS))
    caps = [have[w[0]] * w[2] // size for w in used]
    share = sum(w[1] for w in used)
    seats = int(min((c / (w[1] / share) for c, w in zip(caps, used)), default=0)) if total_tokens is None else total_tokens // size
    quota = dict(zip((w[0] for w in used), sainte_lague([w[1] for w in used], seats, caps)))

    shards = max(1, -(-supply // shard_tokens))
    dealt = sizes.filter(F.col("source").isin(list(quota)) & (F.col("n_tokens") > 0)) if quota else sizes.limit(0)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(shards)).cast("int")).withColumn("place", F.xxhash64(F.lit(seed + 1), F.col(doc_id)))
    per_shard = dealt.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"))
    repeats = {w[0]: w[2] for w in used}

    def by_shard(pdf):
        pdf = pdf.sort_values("shard")
        name = pdf["source"].iloc[0]
        room = pdf["tokens"].to_numpy(np.int64) * repeats[name]
        want = np.asarray(sainte_lague(pdf["tokens"].tolist(), quota[name], (room // size + 1).tolist()), np.int64) * size
        given = np.minimum(want, room)
        # what a shard is asked beyond all it may give goes to the next ones with room
        room -= given
        pdf["quota"] = given + np.clip((want - given).sum() - (np.cumsum(room) - room), 0, room)
        return pdf[["source", "shard", "tokens", "quota"]]

    # one row for each shard of a source; the quota in tokens
    quotas = per_shard.groupBy("source").applyInPandas(by_shard, "source string, shard int, tokens long, quota long")
    placed = dealt.join(quotas, ["source", "shard"]).withColumn("passes", F.floor(F.col("quota") / F.col("tokens"))).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    # the window, unlike a repartition, binds the plan to keep each shard whole and in order up to the Python stage
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "shard").orderBy("place", doc_id))).select(doc_id, "source", "shard", "place", "n_tokens", "passes", "rest", "nth")
    filled = cut_lineage(placed.mapInArrow(fill, T.StructType([*placed.schema.fields, T.StructField("taken", T.BooleanType())])))
    copies = F.col("passes") + F.col("taken").cast("long")
    # one row for each source that has a target
    left = {r[0]: quota[r[0]] * size - int(r[1]) for r in filled.groupBy("source").agg(F.sum(F.col("n_tokens") * copies)).collect()}
    if any(left.values()):
        # what the shards of a source leave together goes to its smallest documents that are still out, till none fits
        of_source = {k: F.element_at(F.create_map(*[F.lit(x) for kv in sorted(by.items()) for x in kv]), F.col("source")) for k, by in (("left", left), ("most", repeats))}
        smallest, out = F.struct("n_tokens", "place", doc_id), ~F.col("taken") & (F.col("passes") < of_source["most"])
        more = filled.withColumn("left", of_source["left"]).filter(out & (F.col("n_tokens") <= F.col("left")))
        for within in (["source", "shard"], ["source"]):  # a shard offers no more than the source has left
            more = more.withColumn("sum", F.sum("n_tokens").over(Window.partitionBy(*within).orderBy("n_tokens", "place", doc_id))).filter("sum <= left")
        last = more.groupBy("source").agg(F.max(smallest).alias("last"))
        filled = filled.join(F.broadcast(last), "source", "left").withColumn("taken", F.col("taken") | (out & F.coalesce(smallest <= F.col("last"), F.lit(False))))
    filled = filled.withColumn("copies", copies)
    mixed = filled.filter("copies > 0").select(doc_id, "source", "n_tokens", "copies")

    # one row for each source that has a target
    most = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(repeats.items()) for x in kv]), F.col("source")) if repeats else F.lit(0)
    out = filled.groupBy("source").agg(F.min(F.when(~F.col("taken") & (F.col("copies") < most), F.col("n_tokens"))).alias("smallest_out"))
    asked = spark.createDataFrame([(k, v * size) for k, v in quota.items()], "source string, quota_tokens long")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    reached = reached.withColumn("actual_share", F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))  # one row a target
    available = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    table = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
    report = table.join(available, "source", "full").join(reached, "source", "left").join(asked, "source", "left").join(out, "source", "left").fillna(0, ["available_tokens", "mixed_tokens", "quota_tokens"])
    left_over = F.col("quota_tokens") - F.col("mixed_tokens")
    report = report.withColumn("filled", (left_over >= 0) & ((left_over == 0) | F.col("smallest_out").isNull() | (left_over < F.col("smallest_out"))))
    any_mixed = F.lit(bool(quota) and any(quota.values()))
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "quota_tokens", "mixed_tokens", F.when(any_mixed, F.coalesce("actual_share", F.lit(0.0))).alias("actual_share"), "filled")
    return mixed, report
