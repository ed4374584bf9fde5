"""Order-preserving whole numbers for dates that a timestamp cannot hold.

Months and days ``00``, and years outside 1..9999, have no timestamp.  The ordinal counts seconds in a
calendar of 13 months of 32 days, which keeps the order of all such dates.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TIME = r"^([+-]?)([0-9]{4,9})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?Z?$"
_PARSED = re.compile(DATE_TIME)
#: How many of the next smaller unit a year, month, day, hour and minute have.
UNITS = (13, 32, 24, 60, 60)


def _folded(parts):
    total = parts[0]
    for unit, part in zip(UNITS, parts[1:]):
        total = total * unit + part
    return total


def ordinal_of(text: str) -> int | None:
    """The ordinal of a date-time text, None if it is none."""
    m = _PARSED.match(text)
    if not m:
        return None
    year, *rest = (int(x) for x in m.groups()[1:])
    if rest[0] > 12 or rest[1] > 31 or rest[2] > 23 or rest[3] > 59 or rest[4] > 59:
        return None
    return _folded([-year if m[1] == "-" else year, *rest])


def as_timestamp(text: str) -> datetime | None:
    """The date-time of a text if a timestamp can hold it."""
    m = _PARSED.match(text)
    if not m or m[1] == "-":
        return None
    try:
        return datetime(*(int(x) for x in m.groups()[1:]))
    except ValueError:
        return None


def ordinal_of_timestamp(column: Column) -> Column:
    return _folded([f(column).cast("long") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)])


def ordinal_of_text(column: Column) -> Column:
    """Column version of :func:`ordinal_of`; null where the text is no date-time."""
    part = [F.regexp_extract(column, DATE_TIME, i + 1) for i in range(7)]
    numbers = [p.try_cast("long") for p in part[1:]]
    numbers[0] = F.when(part[0] == "-", -numbers[0]).otherwise(numbers[0])
    valid = column.rlike(DATE_TIME) & (numbers[1] <= 12) & (numbers[2] <= 31) & (numbers[3] <= 23) & (numbers[4] <= 59) & (numbers[5] <= 59)
    return F.when(valid, _folded(numbers))


def text_of_ordinal(column: Column) -> Column:
    """The date-time text of an ordinal."""
    parts, rest = [], column
    for unit in reversed(UNITS):
        parts.append(F.pmod(rest, F.lit(unit)))
        rest = F.floor(rest / F.lit(unit)) if unit == 1 else ((rest - F.pmod(rest, F.lit(unit))) / F.lit(unit)).cast("long")
    second, minute, hour, day, month = parts
    sign = F.when(rest < 0, "-").otherwise("+")
    return F.when(column.isNotNull(), F.concat(sign, F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", F.abs(rest), month, day, hour, minute, second)))
