"""Queries of the general data problems, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import digest, heavy, instants, orphans, pairs, rejects, wide
from graphloom.session import cut_lineage, shared_folder

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Run times are plausible from 0 up to a day in milliseconds.
TIME_RANGE = (0.0, 86_400_000.0)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_map(df: DataFrame, key: str, value: str, most: int = 20_000) -> dict[str, str]:
    """A small table as a dict, refused if it has more than ``most`` rows."""
    rows = df.select(key, value).filter(F.col(key).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{key}: more than {most} rows")
    return dict(sorted((r[0], r[1]) for r in rows if r[1] is not None))


# 1. percentiles


def p1_percentiles_by_day_status(spark: SparkSession, sf: str) -> DataFrame:
    return digest.percentiles(_table(spark, sf, "milldb_runs"), ["run_day", "status"], "time_ms", QUANTILES, lo=TIME_RANGE[0], hi=TIME_RANGE[1])


def p1_percentiles_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per status, out of a stored table of digests per day and status: the rows are not read again for the estimates."""
    runs = _table(spark, sf, "milldb_runs")
    daily = digest.merge_digests(digest.build_digests(runs, ["run_day", "status"], "time_ms", lo=TIME_RANGE[0], hi=TIME_RANGE[1]), ["run_day", "status"])
    stored = f"{shared_folder(spark)}/graphloom-daily-digests-{uuid4().hex}"
    daily.write.parquet(stored)
    days = 1 << 16  # the number of a day; a digest of no day goes with the first
    daily = spark.read.parquet(stored).withColumn("__node", F.coalesce(F.pmod(F.unix_date("run_day"), F.lit(days)), F.lit(0)).cast("int"))
    return digest.percentiles(runs, ["status"], "time_ms", QUANTILES, digests=daily, nodes=days, lo=TIME_RANGE[0], hi=TIME_RANGE[1])


def p1_certified_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What is exact about the percentiles per day and status: counts and that each rank error is within 0.5 %."""
    found = p1_percentiles_by_day_status(spark, sf)
    return found.select("run_day", "status", "q", "n", "n_null", "n_nan", "n_out_of_range", "certified")


# 2. wide tables


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    declared = small_map(_table(spark, sf, "prop_keys"), "key", "declared_type")
    zones = small_map(_table(spark, sf, "feeds"), "feed", "zone")
    return wide.widen(_table(spark, sf, "node_props"), declared, zones, feed="feed")


def p2_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The number and string cells of the wide table, read off it again as (variable, key, value by type)."""
    declared = small_map(_table(spark, sf, "prop_keys"), "key", "declared_type")
    kinds = {k: t for k, t in declared.items() if t != "datetime"}
    table = wide.widen(_table(spark, sf, "node_props"), kinds)
    columns = dict(zip(sorted(kinds), table.columns[1:-1]))
    cell = lambda k, t: F.col(f"`{columns[k]}`") if kinds[k] == t else F.lit(None).cast(t)
    cells = F.array(*[F.struct(F.lit(k).alias("key"), *[cell(k, t).alias(f"{t}_value") for t in ("long", "double", "string")]) for k in columns])
    found = table.select("variable", F.explode(cells).alias("c")).select("variable", "c.*")
    return found.filter("long_value IS NOT NULL OR double_value IS NOT NULL OR string_value IS NOT NULL")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells declared long or double whose deciding value does not fit, read off the wide table."""
    declared = small_map(_table(spark, sf, "prop_keys"), "key", "declared_type")
    numbers = {k: t for k, t in declared.items() if t in ("long", "double")}
    table = wide.widen(_table(spark, sf, "node_props"), numbers)
    return table.select("variable", F.explode(table.columns[-1]).alias("key"))


# 3. heavy keys


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy.heavy_keys(_table(spark, sf, "edges_tsv"), ["from_id", "type"], "to_id", "loaded_at").select("field", "key_value")


def p3_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return heavy.tree_aggregate(_table(spark, sf, "edges_tsv"), ["from_id", "type"], "to_id", "loaded_at")


# 4. broken rows


def _lines(spark: SparkSession, sf: str, name: str, form: rejects.LineFormat) -> DataFrame:
    return rejects.load_lines(_table(spark, sf, name), form, keep=["line_id", "file_name", "load_day"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        _lines(spark, sf, name, form).filter(F.col("reason").isNotNull()).select(F.lit(name).alias("table_name"), "line_id")
        for name, form in (("lsqb_lines", rejects.LSQB_RESULTS), ("neo4j_lines", rejects.NEO4J_RESULTS))
    ]
    return parts[0].unionByName(parts[1])


def p4_lsqb_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.valid_rows(_lines(spark, sf, "lsqb_lines", rejects.LSQB_RESULTS))


def p4_neo4j_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.valid_rows(_lines(spark, sf, "neo4j_lines", rejects.NEO4J_RESULTS))


def p4_rejects(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        rejects.rejected_rows(_lines(spark, sf, name, form), form).withColumn("table_name", F.lit(name))
        for name, form in (("lsqb_lines", rejects.LSQB_RESULTS), ("neo4j_lines", rejects.NEO4J_RESULTS))
    ]
    return parts[0].unionByName(parts[1])


# 5. orphans

def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    edges = _table(spark, sf, "edges_tsv").select("edge_id", "loaded_at", "day", F.explode(F.array(*[F.struct(F.lit(i).alias("source"), F.col(f).alias("variable")) for i, f in enumerate(("from_id", "to_id"))])).alias("r"))
    edges = edges.select(F.col("edge_id").alias("row_id"), F.col("loaded_at").alias("at"), F.col("day").alias("period"), "r.source", "r.variable")
    props = _table(spark, sf, "node_props").select(F.col("prop_id").alias("row_id"), F.col("loaded_at").alias("at"), F.to_date("loaded_at").alias("period"), F.lit(2).alias("source"), "variable")
    found = orphans.find_orphans(edges.unionByName(props), _table(spark, sf, "nodes_tsv"), ["variable"], match="simple", at="at", born="loaded_at", died="removed_at")
    table = F.when(F.col("source") == 2, "node_props").otherwise("edges_tsv")
    field = F.element_at(F.array(F.lit("from_id"), F.lit("to_id"), F.lit("variable")), F.col("source") + 1)
    return found.select(table.alias("table_name"), "row_id", field.alias("field"), "period")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_id", "field")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf), ["table_name", "field", "period"])


def p5_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose pair of ends no KNOWS edge of a second loading joins, for each match semantics of partly null pairs.

    Targets are the KNOWS edges that were loaded after their own day.
    """
    edges = _table(spark, sf, "edges_tsv")
    late = edges.filter((F.col("type") == "KNOWS") & (F.to_date("loaded_at") > F.col("day"))).select("from_id", "to_id")
    refs = edges.select("edge_id", "from_id", "to_id")
    parts = [orphans.find_orphans(refs, late, ["from_id", "to_id"], match=m).select(F.lit(m).alias("semantics"), "edge_id") for m in ("simple", "full", "partial")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# 6. instants


def _times(spark: SparkSession, sf: str, zones: dict[str, str]) -> DataFrame:
    """node_props rows of datetime keys with what their value denotes: instant, local, explicit (microseconds)."""
    dated = [k for k, t in small_map(_table(spark, sf, "prop_keys"), "key", "declared_type").items() if t == "datetime"]
    props = _table(spark, sf, "node_props").select("prop_id", "variable", wide.trimmed("key").alias("key"), wide.trimmed("value").alias("value"), "feed", "loaded_at")
    props = props.filter(F.col("key").isin(dated) & F.col("value").isNotNull())
    read = instants.read_times(F.col("value"), instants.zone_column(F.col("feed"), zones), zones)
    return props.withColumn("r", read).select("prop_id", "variable", "key", "value", "feed", "loaded_at", "r.instant", "r.local", "r.explicit")


def _estimated(spark: SparkSession, sf: str, zones: dict[str, str]) -> DataFrame:
    """Zones estimated from local times beside another statement of the same cell that says its zone."""
    times = cut_lineage(_times(spark, sf, zones).filter(F.col("variable").isNotNull() & F.col("feed").isNotNull()).select("variable", "key", "feed", "local", "explicit"))
    told = times.filter(F.col("explicit").isNotNull()).select("variable", "key", F.col("explicit").alias("anchor")).distinct()
    local = times.filter(F.col("local").isNotNull()).select("variable", "key", "feed", "local").distinct()
    # only times near each other meet: each lies in a span, anchors also in the spans on either side
    span = instants.WITHIN_HOURS * 3_600_000_000
    near = lambda c: F.floor(F.col(c) / F.lit(span)).cast("long")
    told = told.withColumn("span", F.explode(F.array(near("anchor") - 1, near("anchor"), near("anchor") + 1)))
    both = local.withColumn("span", near("local")).join(told, ["variable", "key", "span"])
    return instants.estimate_zones(both, "feed", "local", "anchor", sorted(set(zones.values())))


def _all_zones(spark: SparkSession, sf: str) -> dict[str, str]:
    """Declared zones, and an estimated one for every feed that declares none."""
    declared = small_map(_table(spark, sf, "feeds"), "feed", "zone")
    seen = _table(spark, sf, "node_props").select("feed").filter(F.col("feed").isNotNull() & ~F.col("feed").isin(list(declared))).distinct()
    if not seen.limit(1).count():
        return declared
    found = _estimated(spark, sf, declared).join(seen.withColumnRenamed("feed", "source"), "source", "left_semi")
    return small_map(found, "source", "zone") | declared


def p6_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every datetime value with its UTC instant in microseconds since 1970, null where it denotes none."""
    return _times(spark, sf, _all_zones(spark, sf)).select("prop_id", "variable", "key", "value", "feed", F.col("instant").alias("instant_us"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    times = _times(spark, sf, _all_zones(spark, sf)).select("variable", "key", "instant", "value", "prop_id")
    times = cut_lineage(times)  # texts are read once; a filter before this would make the plan read them twice
    return pairs.differing_pairs(times.filter(F.col("instant").isNotNull()), ["variable", "key", "instant"], "value", "prop_id")


def _told(spark: SparkSession, sf: str) -> DataFrame:
    return _estimated(spark, sf, small_map(_table(spark, sf, "feeds"), "feed", "zone"))


def p6_zone_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """The zone of every feed as the data tell it, without its declared zone; null with the reason where they do not."""
    return _told(spark, sf).withColumnRenamed("source", "feed")


def p6_zone_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds whose zone the data tell otherwise than it is declared."""
    told = _told(spark, sf).filter("zone IS NOT NULL").select(F.col("source").alias("feed"), F.col("zone").alias("told_zone"))
    return told.join(_table(spark, sf, "feeds"), "feed").filter("zone <> told_zone").select("feed", "zone", "told_zone")


def p6_instants_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """As ``p6_instants``, with every declared zone withheld: local times take the zone that the data tell, or none."""
    zones = small_map(_told(spark, sf).filter("zone IS NOT NULL"), "source", "zone")
    return _times(spark, sf, zones).select("prop_id", "variable", "key", "value", "feed", F.col("instant").alias("instant_us"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_percentiles_by_day_status, p1_percentiles_by_status, p1_certified_counts, p2_found, p2_wide, p2_cells, p3_found, p3_per_key,
        p4_found, p4_lsqb_rows, p4_neo4j_rows, p4_rejects, p5_found, p5_report, p6_found, p6_instants, p6_zone_estimates,
        p6_zone_contradictions, p6_instants_estimated, p5_composite,
    )
}
