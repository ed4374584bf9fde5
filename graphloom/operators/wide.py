"""Entity, attribute, value rows into one wide row per entity with typed columns.

Cells are decided before any entity is gathered: a partial aggregate by entity and attribute keeps
the last statement of each cell, so an entity that holds a third of all rows shrinks to one row per
attribute on the map side.  Text is turned into typed values inside the JVM.  Entities are then
hash-bucketed and ordered within their bucket; each Arrow batch is dictionary-encoded by entity and
its values are scattered by (row, column) index into one numpy array per type, which become the
columns of the emitted Arrow table.  A task holds one batch and one unfinished entity at a time.

Defined results
* null entities are dropped; an entity without any usable cell still gets its row of nulls.
* attributes that are not declared are ignored; null values decide nothing; an empty string is a value.
* a deciding value that does not fit its type is null in the table and named in ``unfit``.
* equal order numbers within a cell: the greater text wins.
* attribute names that clash with another column, also by case, get a suffix ``_2``, ``_3``, ...
* an empty table gives no rows, but all columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.instants import to_instant
from graphloom.session import fresh_name

BLANKS = " \t\n\r\x0b\x0c"
LONG = r"\A[+-]?[0-9]+\z"
DOUBLE = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
TYPES = ("long", "double", "datetime", "string")
MAX_COLUMNS = 20_000
#: So many cells of the numpy arrays are held at once.
GRID_CELLS = 1 << 22


def trimmed(name: str) -> Column:
    return F.btrim(F.col(f"`{name}`"), F.lit(BLANKS))


def unquoted(text: Column) -> Column:
    """A string value without the pair of quotes that the graph's text format puts around it."""
    quoted = (F.length(text) >= 2) & F.left(text, F.lit(1)).isin('"', "'") & (F.left(text, F.lit(1)) == F.right(text, F.lit(1)))
    return F.when(quoted, F.expr("substring(__v, 2, length(__v) - 2)")).otherwise(text)


def as_long(text: Column) -> Column:
    return F.when(text.rlike(LONG), text.try_cast("long"))


def as_double(text: Column) -> Column:
    number = F.when(text.rlike(DOUBLE), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def _scatter(entity_type: pa.DataType, slots: list[tuple[str, int]], schema_of):
    """slots: type and place within that type of each declared attribute."""
    counts = {t: sum(1 for s, _ in slots if s == t) for t in TYPES}
    by_type = {t: np.array([place if s == t else -1 for s, place in slots], np.int64) for t in TYPES}

    def table(part: pa.Table, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        coded = part.column("__e").combine_chunks().dictionary_encode()
        row = coded.indices.to_numpy().astype(np.int64)
        col = part.column("__c").combine_chunks().to_numpy()
        n = len(coded.dictionary)
        known = col >= 0
        grids: dict[str, tuple] = {}
        for kind, source in (("long", "__l"), ("double", "__d"), ("datetime", "__t")):
            value = part.column(source).combine_chunks()
            there = value.is_valid().to_numpy(zero_copy_only=False) & known
            place = by_type[kind][np.where(known, col, 0)] if len(slots) else np.full(len(col), -1)
            there &= place >= 0
            dtype = np.float64 if kind == "double" else np.int64
            data, has = np.zeros((counts[kind], n), dtype), np.zeros((counts[kind], n), bool)
            data[place[there], row[there]] = value.fill_null(0).to_numpy(zero_copy_only=False)[there]
            has[place[there], row[there]] = True
            grids[kind] = (data, has)
        text = part.column("__s").combine_chunks()
        place = by_type["string"][np.where(known, col, 0)] if len(slots) else np.full(len(col), -1)
        there = text.is_valid().to_numpy(zero_copy_only=False) & known & (place >= 0)
        take = np.full((counts["string"], n), -1, np.int64)
        take[place[there], row[there]] = np.flatnonzero(there)
        bad = part.column("__bad").to_numpy(zero_copy_only=False).astype(bool) & known
        order = np.lexsort((col[bad], row[bad]))
        bad_row, bad_col = row[bad][order], col[bad][order]
        unfit = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(bad_row, np.arange(n + 1)), pa.int32()),
            pa.array(names, pa.string()).take(pa.array(bad_col.astype(np.int64))) if len(names) else pa.array([], pa.string()),
        )
        columns: list[pa.Array] = [coded.dictionary]
        for kind, at in slots:
            if kind == "string":
                index = take[at]
                columns.append(text.take(pa.array(index, mask=index < 0)))
            else:
                data, has = grids[kind]
                columns.append(pa.array(data[at], mask=~has[at]))
        columns.append(unfit)
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    most = max(1, GRID_CELLS // max(1, *counts.values()))

    def tables(part: pa.Table, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """``part`` in runs of at most ``most`` entities, so many columns do not make the arrays large."""
        entity = part.column("__e").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])[::most]
        for a, b in zip(starts, [*starts[1:], part.num_rows]):
            yield table(part.slice(a, b - a), names, schema)

    def run(names: list[str]):
        def each(batches):
            schema, rest = schema_of(), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = pa.Table.from_batches([batch])
                if rest is not None:
                    part = pa.concat_tables([rest, part])
                entity = part.column("__e")
                last = entity[len(entity) - 1]
                start = pa.compute.index(entity, last).as_py()
                if start:
                    yield from tables(part.slice(0, start), names, schema)
                rest = part.slice(start)
            if rest is not None:
                yield from tables(rest, names, schema)

        return each

    return run


def widen(rows: DataFrame, declared: Mapping[str, str], zones: Mapping[str, str] | None = None, *, entity: str = "variable", key: str = "key", value: str = "value", order: str = "prop_id", feed: str | None = None) -> DataFrame:
    """One row per entity: the entity, one column per declared attribute and ``unfit``.

    ``declared`` maps attributes to ``long``, ``double``, ``datetime`` or ``string`` and is part of the
    plan, so its size is checked.  Datetime columns are microseconds since 1970 UTC (LONG), since the
    data reaches back before year 1; ``zones`` maps the values of ``feed`` to their local zone.
    """
    if len(declared) > MAX_COLUMNS:
        raise ValueError(f"{len(declared)} attributes; a table takes at most {MAX_COLUMNS} columns")
    if wrong := set(declared.values()) - set(TYPES):
        raise ValueError(f"unknown types: {sorted(wrong)}")
    spark = rows.sparkSession
    names = sorted(declared)
    slots, seen = [], dict.fromkeys(TYPES, 0)
    for name in names:
        slots.append((declared[name], seen[declared[name]]))
        seen[declared[name]] += 1
    columns = [entity]
    for name in [*names, "unfit"]:
        columns.append(fresh_name(columns, name))
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "datetime": T.LongType(), "string": T.StringType()}
    struct = T.StructType(
        [T.StructField(columns[0], rows.schema[entity].dataType)]
        + [T.StructField(c, kinds[declared[n]]) for c, n in zip(columns[1:], names)]
        + [T.StructField(columns[-1], T.ArrayType(T.StringType(), False))]
    )
    index = spark.createDataFrame([(n, i, declared[n]) for i, n in enumerate(names)], "__k string, __c int, __kind string")
    cells = rows.filter(F.col(f"`{entity}`").isNotNull()).select(
        F.col(f"`{entity}`").alias("__e"), trimmed(key).alias("__k"), trimmed(value).alias("__v"), F.col(f"`{order}`").alias("__o"),
        (F.col(f"`{feed}`") if feed else F.lit(None).cast("string")).alias("__f"),
    )
    # at most MAX_COLUMNS rows
    cells = cells.join(F.broadcast(index), "__k", "left").withColumn("__c", F.coalesce("__c", F.lit(-1)))
    cells = cells.groupBy("__e", "__c", "__kind").agg(F.max(F.when(F.col("__v").isNotNull() & (F.col("__c") >= 0), F.struct("__o", "__v", "__f"))).alias("__last"))
    cells = cells.select("__e", "__c", "__kind", F.col("__last.__v").alias("__v"), F.col("__last.__f").alias("__f"))
    is_a = {t: F.col("__kind") == t for t in TYPES}
    v = F.col("__v")
    instant = F.lit(None).cast("long")
    if "datetime" in declared.values():
        instant = to_instant(F.when(is_a["datetime"], v), F.col("__f"), zones or {})
    typed = cells.select(
        "__e", "__c", "__kind", F.when(is_a["long"], as_long(v)).alias("__l"), F.when(is_a["double"], as_double(v)).alias("__d"),
        instant.alias("__t"), F.when(is_a["string"], unquoted(v)).alias("__s"), "__v",
    )
    fits = F.coalesce(F.col("__l").isNotNull() | F.col("__d").isNotNull() | F.col("__t").isNotNull() | F.col("__s").isNotNull(), F.lit(False))
    typed = typed.select("__e", "__c", "__l", "__d", "__t", "__s", (F.col("__v").isNotNull() & ~fits).alias("__bad"))

    def schema_of():
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(struct)

    run = _scatter(schema_of().field(0).type, slots, schema_of)(names)
    return typed.repartition("__e").sortWithinPartitions("__e").mapInArrow(run, struct)
