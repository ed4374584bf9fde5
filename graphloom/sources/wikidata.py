"""Wikidata JSON dumps to node and edge rows.

The dump is one array with one entity a line.  Item values become edges, values of P31 node labels;
quantities (whole, 64 bits), times (valid, years -9999..9999, month or day 00 read as 01) and strings
become node properties, of which the first usable statement counts; coordinates become ``<P>lat`` and
``<P>lon``.  Edges carry their qualifiers (first value of times, quantities and coordinates) and ``rank``.
Entities without an id and statements that do not fit are skipped; lines that are no JSON give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE_OF = "P31"
_SNAK = "struct<datavalue:struct<value:string>,datatype:string>"
SCHEMA = f"id string, claims map<string,array<struct<mainsnak:{_SNAK},qualifiers:map<string,array<{_SNAK}>>,rank:string>>>"
_TIME = r"^([+-])([0-9]{1,16})-([0-9]{2})-([0-9]{2})(T.*)?$"


def _amount(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\+", "")
    return F.when(bare.rlike(r"^-?[0-9]+$") & bare.try_cast("long").isNotNull(), bare)


def _time(text: Column) -> Column:
    """The time with months and days 00 as 01, null if there is no such date."""
    part = lambda i: F.regexp_extract(text, _TIME, i)
    fixed = lambda i: F.when(part(i) == "00", "01").otherwise(part(i))
    year, month, day = part(2).try_cast("long"), fixed(3).try_cast("int"), fixed(4).try_cast("int")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = text.rlike(_TIME) & (year <= 9999) & month.between(1, 12) & (day <= length)
    return F.when(valid, F.concat(part(1), part(2), F.lit("-"), fixed(3), F.lit("-"), fixed(4), part(5)))


def _coordinate(text: Column) -> Column:
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$"), text)


def _read(value: Column) -> dict[str, Column]:
    """What a value says: item, literal, lat, lon (null where it says something else)."""
    at = lambda path: F.get_json_object(value, path)
    is_object = value.startswith("{")
    quoted = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
    lat, lon = _coordinate(at("$.latitude")), _coordinate(at("$.longitude"))
    both = is_object & lat.isNotNull() & lon.isNotNull()
    return {
        "item": F.when(is_object & at("$.entity-type").isNotNull(), at("$.id")),
        "literal": F.when(is_object, F.coalesce(_amount(at("$.amount")), _time(at("$.time")))).otherwise(quoted),
        "lat": F.when(both, lat),
        "lon": F.when(both, lon),
    }


def read_entities(spark: SparkSession, path: str, *, one_document: bool = False) -> DataFrame:
    """Entities of a dump; ``one_document`` reads files whose array is not broken into lines."""
    if one_document:
        return spark.read.schema(SCHEMA).option("multiLine", True).json(path).filter("id IS NOT NULL")
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\[|[,\]]\s*$", "").alias("value")).filter("value LIKE '{%'")
    return lines.select(F.from_json("value", SCHEMA).alias("e")).select("e.*").filter("id IS NOT NULL")


def read_wikidata(spark: SparkSession, path: str, *, one_document: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of a dump."""
    entities = read_entities(spark, path, one_document=one_document)
    claims = entities.select("id", F.explode("claims").alias("property", "items"))
    items = claims.select("id", "property", F.posexplode("items").alias("at", "item"))
    read = _read(F.col("item.mainsnak.datavalue.value"))
    items = items.select("id", "property", "at", "item.qualifiers", "item.rank", *[c.alias(n) for n, c in read.items()])

    labels = items.filter((F.col("property") == INSTANCE_OF) & F.col("item").isNotNull()).select("id", F.col("item").alias("label")).distinct()
    labels = labels.groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    entry = lambda key, value, order: F.struct(F.col("at").alias("at"), key.alias("k"), value.alias("v"), F.lit(order).alias("order"))
    cells = items.select("id", F.explode(F.array(
        entry(F.col("property"), F.col("literal"), -1), entry(F.concat("property", F.lit("lat")), F.col("lat"), 1), entry(F.concat("property", F.lit("lon")), F.col("lon"), 1)
    )).alias("e")).select("id", "e.*").filter("v IS NOT NULL")
    # of literals the first statement counts, of coordinates the last
    cells = cells.groupBy("id", "k").agg(F.max(F.struct((F.col("at") * F.col("order")).alias("turn"), "v")).alias("last"))
    props = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "last.v"))).alias("props"))
    nodes = entities.select("id").distinct().join(labels, "id", "left").join(props, "id", "left")
    nodes = nodes.select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))

    def qualifier(e: Column) -> Column:
        value = e["value"][0]["datavalue"]["value"]
        said = _read(F.when(value.startswith("{"), value))
        pair = lambda name, text: F.struct(name.alias("key"), text.alias("value"))
        return F.array(pair(e["key"], said["literal"]), pair(F.concat(e["key"], F.lit("lat")), said["lat"]), pair(F.concat(e["key"], F.lit("lon")), said["lon"]))

    said = F.flatten(F.transform(F.coalesce(F.map_entries("qualifiers"), F.array()), qualifier))
    rank = F.struct(F.lit("rank").alias("key"), F.coalesce(F.concat(F.lit('"'), F.col("rank"), F.lit('"')), F.lit("?")).alias("value"))
    all_props = F.map_from_entries(F.concat(F.filter(said, lambda p: p["value"].isNotNull() & (p["key"] != "rank")), F.array(rank)))
    edges = items.filter((F.col("property") != INSTANCE_OF) & F.col("item").startswith("Q"))
    return nodes, edges.select(F.col("id").alias("src"), F.col("property").alias("label"), F.col("item").alias("dst"), all_props.alias("props"))
