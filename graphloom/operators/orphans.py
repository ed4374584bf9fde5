"""References to records that do not exist, with match semantics for partly null composite keys.

References are grouped by the mask of their null key columns; each mask is anti-joined with the
targets on its non-null columns only.  Declared semantics:

* ``simple``  - a reference with any null column refers to nothing and is never an orphan;
* ``full``    - all columns null is no reference, some null is always an orphan;
* ``partial`` - the non-null columns must agree with some target; all null is no reference.

A target may carry a lifetime (``born`` up to, not including, ``died``; null ``died`` = still alive);
then it answers a reference only if alive at the reference's own time.  Target lifetimes are merged
per key to disjoint intervals first, so repeated declarations do not multiply the work.

Skew: the keys with most references are found by a pre-aggregated count (a bounded top list), their
references are split over ``salts`` (as many as shuffle partitions, so over all tasks) and only the few targets of
those keys are repeated.  Lifetimes of a key are merged in ``PARTS`` parts first, then the parts.

Defined results: null reference times answer to no lifetime and are orphans; targets with null key
columns answer no complete reference; empty target tables leave every reference an orphan; empty
reference tables give no rows; repeated references are each reported; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 64
LEAST_SALTS = 16
PARTS = 32


def merged_lifetimes(targets: DataFrame, keys: Sequence[str], born: str, died: str) -> DataFrame:
    """Disjoint, maximal intervals ``(keys, __born, __died)`` per key; intervals without length vanish.

    Equal births are combined before the shuffle; the window streams over a key's births in order.
    """
    rows = targets.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{born}`").alias("__born"), F.col(f"`{died}`").alias("__died"))
    rows = rows.filter(F.col("__born").isNotNull() & (F.col("__died").isNull() | (F.col("__died") > F.col("__born"))))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__born"), F.lit(PARTS)))
    rows = rows.groupBy(*keys, "__part", "__born").agg(F.max(F.col("__died").isNull()).alias("__open"), F.max("__died").alias("__died"))
    for by in ([*keys, "__part"], list(keys)):
        order = Window.partitionBy(*by).orderBy("__born")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__new", F.coalesce(~F.max("__open").over(before) & (F.max("__died").over(before) < F.col("__born")), ~F.coalesce(F.max("__open").over(before), F.lit(False))).cast("int"))
        rows = rows.withColumn("__run", F.sum("__new").over(order))
        rows = rows.groupBy(*by, "__run").agg(F.min("__born").alias("__born"), F.max("__open").alias("__open"), F.max("__died").alias("__died")).drop("__run")
    return rows.select(*keys, "__born", F.when(~F.col("__open"), F.col("__died")).alias("__died"))


def _hot(refs: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """The ``most`` keys with the most references.  Any key with a share of 1 / ``most`` is among them."""
    counts = refs.groupBy(*columns).agg(F.count(F.lit(1)).alias("__c"))
    return counts.orderBy(F.desc("__c"), *columns).limit(most).select(*columns, F.lit(True).alias("__hot"))


def _missing(refs: DataFrame, targets: DataFrame, columns: list[str], at: str | None, hot_keys: int, salts: int) -> DataFrame:
    """References without a target that agrees on ``columns`` (none of them null in ``refs``)."""
    hot = F.broadcast(_hot(refs, columns, hot_keys))  # at most hot_keys rows
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = refs.withColumn("__turn", turn).join(hot, columns, "left").withColumn("__salt", F.when(F.col("__hot"), F.col("__turn")).otherwise(0)).drop("__hot", "__turn")
    spread = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    names = {c: f"__t_{c}" for c in columns}
    wide = targets.join(hot, columns, "left").withColumn("__tsalt", F.explode(spread)).drop("__hot")
    wide = wide.select(*[F.col(c).alias(n) for c, n in names.items()], "__tsalt", *[c for c in ("__born", "__died") if c in targets.columns])
    on = F.col("__salt") == F.col("__tsalt")
    for c, n in names.items():
        on &= F.col(c) == F.col(n)
    if at:
        on &= (F.col("__born") <= F.col(at)) & (F.col("__died").isNull() | (F.col("__died") > F.col(at)))
    return salted.join(wide, on, "left_anti").drop("__salt")


def find_orphans(refs: DataFrame, targets: DataFrame, keys: Sequence[str], *, match: str = "simple", at: str | None = None, born: str | None = None, died: str | None = None, hot_keys: int = HOT_KEYS, salts: int | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``keys`` no row of ``targets`` answers (key columns of equal names)."""
    if match not in ("simple", "full", "partial"):
        raise ValueError("match is simple, full or partial")
    if at and not (born and died):
        raise ValueError("a reference time needs the targets' born and died columns")
    salts = salts or max(LEAST_SALTS, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = refs.columns
    place = {name: f"c{i}" for i, name in enumerate(names)}  # work under names that clash with nothing
    refs = refs.toDF(*place.values())
    targets = targets.select(*[F.col(f"`{k}`").alias(place[k]) for k in keys], *([F.col(f"`{born}`").alias("born"), F.col(f"`{died}`").alias("died")] if at else []))
    keys, at = [place[k] for k in keys], place[at] if at else None
    everything = (1 << len(keys)) - 1
    mask = sum((F.when(F.col(f"`{k}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
    if match == "full":
        partly = refs.filter((mask != 0) & (mask != everything))
    masks = [0] if match in ("simple", "full") else range(everything)
    out = None
    for m in masks:
        columns = [k for i, k in enumerate(keys) if not m >> i & 1]
        group = refs.filter(mask == m)
        complete = targets
        for c in columns:
            complete = complete.filter(F.col(f"`{c}`").isNotNull())
        held = merged_lifetimes(complete, columns, "born", "died") if at else complete.select(*columns).distinct()
        found = _missing(group, held, columns, at, hot_keys, salts).select(*refs.columns)
        out = found if out is None else out.unionByName(found)
    return (out.unionByName(partly) if match == "full" else out).toDF(*names)


def orphan_report(orphans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Numbers of orphan references per table, field and period (the columns ``by``)."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
