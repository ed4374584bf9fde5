"""Mixed timestamp formats and time zones to one UTC instant (microseconds since 1970).

Reading rules
* an explicit offset, ``Z``, zone abbreviation or zone name counts, an offset or abbreviation before a
  zone name; without one the time is local to the zone of its source;
* a local time that occurs twice means the earlier instant, one that is skipped means none;
* plain numbers count from 1970 UTC in seconds, in milliseconds if they have 13 digits;
* slashes mean month/day/year, dots day.month.year; a month or day ``00`` means ``01``;
* fractions are cut to microseconds; dates that do not exist and all other text denote nothing.

Null text, or a local time of a source without a zone, gives null.  Years run from -9999 to 9999.

The plain forms (ISO date and time with ``Z`` or an offset of hours and minutes, whole numbers of up to 13 digits)
are read inside the JVM; only other texts and local times go to Python, in Arrow batches.

Where a source declares no zone, :func:`estimate_zones` finds one: each candidate zone's offset
history is applied to the source's local timestamps, which are aligned with a time that limits them
(ingestion or the neighbour in sequence) or that they should equal (the same fact stated with
a zone); the zone with the fewest violations is chosen.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Local times and their instants lie less far apart than this; 26 hours are the most that offsets span.
WITHIN_HOURS = 30
_CLOCK = r"(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]{1,12}))?)?(?:\s?(?P<ap>[AaPp])\.?[Mm]\.?)?"
_TAIL = r"\s?(?P<off>[Zz]|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)?(?:\s?(?P<abbr>[A-Za-z]{2,5}))?(?:\s?(?P<zone>\[[A-Za-z0-9_+\-/]+\]|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+))?"
_MONTH = r"(?P<mon>[A-Za-z]{3,9})\.?"
_FORMS = [
    re.compile(p + r"\Z")
    for p in (
        r"(?P<sign>[+-]?)(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})(?:[Tt]|\s)" + _CLOCK + _TAIL,
        r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})[Tt](?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?:(?P<s>[0-9]{2})(?:\.(?P<f>[0-9]{1,12}))?)?" + _TAIL,
        r"(?P<m>[0-9]{1,2})/(?P<d>[0-9]{1,2})/(?P<y>[0-9]{4}),?\s" + _CLOCK + _TAIL,
        r"(?P<d>[0-9]{1,2})\.(?P<m>[0-9]{1,2})\.(?P<y>[0-9]{4}),?\s" + _CLOCK + _TAIL,
        r"(?:[A-Za-z]{3,9},?\s)?(?P<d>[0-9]{1,2})\s" + _MONTH + r"\s(?P<y>[0-9]{4}),?\s" + _CLOCK + _TAIL,
        r"(?:[A-Za-z]{3,9},?\s)?" + _MONTH + r"\s(?P<d>[0-9]{1,2}),?\s(?P<y>[0-9]{4}),?\s" + _CLOCK + _TAIL,
        r"(?P<sign>[+-]?)(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})" + _TAIL,
        r"(?P<m>[0-9]{1,2})/(?P<d>[0-9]{1,2})/(?P<y>[0-9]{4})" + _TAIL,
        r"(?P<d>[0-9]{1,2})\.(?P<m>[0-9]{1,2})\.(?P<y>[0-9]{4})" + _TAIL,
    )
]
_NUMBER = re.compile(r"(?P<sign>[+-]?)(?P<n>[0-9]+)(?:\.(?P<f>[0-9]{1,12}))?\Z")
_WRAPPED = re.compile(r"(?:ZONED_DATETIME|datetime|dateTimeStamp)\(\s*(['\"])(.*)\1\s*\)\Z", re.S)
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_LONG_MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
#: What Spark's own cast reads as the rules want it, once months and days 00 are 01.
_PLAIN = r"\A[+-]?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
_COUNT = r"\A[+-]?[0-9]{1,13}\z"
_EPOCH = datetime(1970, 1, 1)
_DAY0 = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=4096)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def abbreviations(zones: Mapping[str, str]) -> dict[str, int]:
    """Seconds east of UTC of every abbreviation that the zones' clocks have shown since 1970."""
    found = {"UTC": 0, "GMT": 0, "Z": 0}
    for name in sorted(set(zones.values())):
        zone = zone_of(name)
        for year in range(1970, 2038) if zone else ():
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 1, tzinfo=zone)
                if at.tzname().isalpha():
                    found.setdefault(at.tzname(), int(at.utcoffset().total_seconds()))
    return found


def _days(year: int, month: int, day: int) -> int | None:
    """Days since 1970 in the proleptic Gregorian calendar, any year; None if there is no such date."""
    shift = 0
    if not 1 <= year <= 9999:
        shift = (year - 2000) // 400
        year -= 400 * shift
    try:
        return date(year, month, day).toordinal() - _DAY0 + shift * 146097
    except ValueError:
        return None


def local_to_utc(micros: int, zone: ZoneInfo) -> int | None:
    """The earlier instant of a local time in a zone, None if the clock skipped it."""
    try:
        local = _EPOCH + timedelta(microseconds=micros)
        offset = local.replace(tzinfo=zone).utcoffset()
        utc = local - offset
        back = utc.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
    except OverflowError:  # before year 1: the zone's first offset holds
        return micros - int(datetime(1, 1, 3, tzinfo=zone).utcoffset().total_seconds()) * 1_000_000
    return (utc - _EPOCH) // timedelta(microseconds=1) if back == local else None


def parse_instant(text: str | None, zone: str | None, abbr: Mapping[str, int]) -> tuple[int | None, int | None, int | None]:
    """``(instant, local, explicit)`` of a trimmed text.

    The instant is in microseconds UTC; local is the wall clock that was read, where no zone stood by
    it; explicit is the instant where the text itself said the zone.
    """
    nothing = (None, None, None)
    if not text:
        return nothing
    if wrapped := _WRAPPED.match(text):
        text = wrapped[2].strip()
    if number := _NUMBER.match(text):
        digits = number["n"]
        if len(digits) > 18:
            return nothing
        scale = 3 if len(digits) == 13 else 6
        fraction = (number["f"] or "").ljust(scale, "0")[:scale]
        micros = int(digits) * 10**scale + int(fraction or 0)
        micros = -micros if number["sign"] == "-" else micros
        return (micros, None, micros) if abs(micros) < 1 << 62 else nothing
    for form in _FORMS:
        if m := form.match(text):
            break
    else:
        return nothing
    g = m.groupdict()
    if "mon" in g and g["mon"] is not None:
        low = g["mon"].lower()
        month = _MONTHS.get(low) or _LONG_MONTHS.get(low)
        if not month:
            return nothing
    else:
        month = int(g["m"]) or 1
    year = int(g["y"]) * (-1 if g.get("sign") == "-" else 1)
    days = _days(year, month, int(g["d"]) or 1)
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return nothing
        hour = hour % 12 + (12 if g["ap"] in "Pp" else 0)
    if days is None or hour > 23 or minute > 59 or second > 59:
        return nothing
    micros = ((days * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + int((g.get("f") or "0").ljust(6, "0")[:6])
    if off := g["off"]:
        seconds = 0
        if off not in "Zz":
            digits = off[1:].replace(":", "").ljust(6, "0")
            if int(digits[:2]) > 18 or int(digits[2:4]) > 59 or int(digits[4:]) > 59:
                return nothing
            seconds = (int(digits[:2]) * 3600 + int(digits[2:4]) * 60 + int(digits[4:])) * (-1 if off[0] == "-" else 1)
        if g["zone"] and not zone_of(g["zone"].strip("[]")):
            return nothing
        return micros - seconds * 1_000_000, None, micros - seconds * 1_000_000
    if name := g["abbr"]:
        if name.upper() not in abbr:
            return nothing
        instant = micros - abbr[name.upper()] * 1_000_000
        return instant, None, instant
    if named := g["zone"]:
        own = zone_of(named.strip("[]"))
        instant = local_to_utc(micros, own) if own else None
        return instant, None, instant
    own = zone_of(zone) if zone else None
    return (local_to_utc(micros, own) if own else None), micros, None


_READ = T.StructType([T.StructField("instant", T.LongType()), T.StructField("local", T.LongType()), T.StructField("explicit", T.LongType())])


def read_times(text: Column, zone: Column, zones: Mapping[str, str]) -> Column:
    """Struct (instant, local, explicit) of each text; ``zone`` is the IANA name for local times."""
    abbr = abbreviations(zones)

    @F.pandas_udf(_READ)
    def read(texts, names):
        import pandas as pd

        rows = [parse_instant(t if isinstance(t, str) else None, z if isinstance(z, str) else None, abbr) for t, z in zip(texts, names)]
        return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(("instant", "local", "explicit"))})

    digits = F.length(F.regexp_replace(text, "^[+-]", ""))
    counted = text.try_cast("long") * F.when(digits == 13, F.lit(1_000)).otherwise(F.lit(1_000_000))
    bare = F.regexp_replace(text, r"\AZONED_DATETIME\('(.*)'\)\z", "$1")
    stamp = F.regexp_replace(bare, "-00(?=[-T ])", "-01").try_cast("timestamp")
    by_jvm = F.when(bare.rlike(_PLAIN), F.unix_micros(stamp)).when(text.rlike(_COUNT), counted)
    rest = read(F.when(by_jvm.isNull(), text), zone)
    return F.struct(F.coalesce(by_jvm, rest["instant"]).alias("instant"), rest["local"].alias("local"), F.coalesce(by_jvm, rest["explicit"]).alias("explicit"))


def zone_column(feed: Column, zones: Mapping[str, str]) -> Column:
    """The declared zone of a feed; the mapping is part of the plan and holds one entry a feed."""
    if not zones:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(zones.items()) for x in kv]), feed)


def to_instant(text: Column, feed: Column, zones: Mapping[str, str]) -> Column:
    """Microseconds UTC of each text, null where it denotes nothing."""
    return read_times(text, zone_column(feed, zones), zones)["instant"]


#: A zone is told apart from another by so many more agreeing rows, in all and as a share of the aligned rows.
LEAST_LEAD, LEAD_SHARE = 8, 0.1


def estimate_zones(
    rows: DataFrame, source: str, local: str, anchor: str, candidates: list[str], *, relation: str = "equal", within_hours: int = WITHIN_HOURS, least_lead: int = LEAST_LEAD, lead_share: float = LEAD_SHARE
) -> DataFrame:
    """The zone of each source from the alignment of its local timestamps with anchor times.

    ``local`` and ``anchor`` are microseconds.  ``relation``: ``equal`` - the anchor is the same instant
    told with a zone, pairs further apart than ``within_hours`` tell nothing; ``before`` - the anchor is an ingestion
    time or a later neighbour in sequence, which the timestamp must not pass.  Result: (source, zone,
    n_violations, n_aligned, lead, reason).  ``lead`` is by how many violations the next zone is worse than the
    best one.  The zone is null, with the reason, where the data do not tell: no row agrees with the best one, or its lead
    is below ``least_lead`` or ``lead_share`` of the aligned rows (ties among them).  A single candidate leads by
    the rows that agree with it.  Sources without any pair have no row.  Rows are counted
    by partial aggregates; the candidates are a list in the plan.
    """
    rows = rows.filter(F.col(source).isNotNull() & F.col(local).isNotNull() & F.col(anchor).isNotNull())
    if relation == "equal":
        rows = rows.filter(F.abs(F.col(local) - F.col(anchor)) <= within_hours * 3_600_000_000)
    wall = F.timestamp_micros(F.col(local))
    tried = rows.select(F.col(source).alias("source"), F.col(anchor).alias("anchor"), wall.alias("wall"), F.explode(F.array(*[F.lit(z) for z in sorted(candidates)])).alias("zone"))
    utc = F.unix_micros(F.to_utc_timestamp("wall", F.col("zone")))
    wrong = (utc != F.col("anchor")) if relation == "equal" else (utc > F.col("anchor"))
    scored = tried.groupBy("source", "zone").agg(F.sum(wrong.cast("long")).alias("n_violations"), F.count(F.lit(1)).alias("n_aligned"))
    best = Window.partitionBy("source").orderBy("n_violations", "zone")  # one row a candidate
    ranked = scored.withColumn("__r", F.row_number().over(best)).withColumn("lead", F.coalesce(F.lead("n_violations").over(best), F.col("n_aligned")) - F.col("n_violations")).filter("__r = 1")
    reason = F.when(F.col("n_violations") == F.col("n_aligned"), "no row agrees").when((F.col("lead") < least_lead) | (F.col("lead") < lead_share * F.col("n_aligned")), "lead too small")
    return ranked.select("source", F.when(reason.isNull(), F.col("zone")).alias("zone"), "n_violations", "n_aligned", "lead", reason.alias("reason"))
