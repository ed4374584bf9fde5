"""A LONG for each row of a Parquet table that is the same in every scan, whatever the number of files.

A row's number is the number of its file and its place within the file.  Files are numbered by a perfect hash:
their path hashes fall into small groups, and each group gets the first shift that sends all of its files to
free numbers.  The shifts are an array in the plan (a quarter as many as files), so numbering is plain
arithmetic on a scan's own columns: no join, no job and no dependence on how files are split into tasks.

Defined results: an empty table has no files and no rows; more than ``2 ** FILE_BITS`` files are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BITS, FILE_BITS = 36, 24
#: A mask of 31 bits, which is a prime as well.
_HALF = (1 << 31) - 1
#: The seed of Spark's own hash function (a fixed value).
_SPARK_SEED = 42


def _hash(path: str) -> int:
    value = xxhash.xxh64_intdigest(path.replace("file:///", "file:/").encode(), _SPARK_SEED)
    return value - (1 << 64) if value >> 63 else value


def file_shifts(paths: Sequence[str]) -> tuple[list[int], int]:
    """The shift of each group of paths and the number of file numbers; no two paths get the same number."""
    hashes = [_hash(p) for p in paths]
    if len(set(hashes)) < len(hashes):
        raise ValueError("two files of a table have the same path hash")
    size = 1
    while 4 * size < 5 * len(hashes):
        size *= 2
    if size > 1 << FILE_BITS:
        raise ValueError(f"more files than {1 << FILE_BITS} numbers")
    groups: list[list[int]] = [[] for _ in range(max(1, len(hashes) // 4))]
    for h in hashes:
        groups[h % len(groups)].append(h)
    taken, shifts = bytearray(size), [0] * len(groups)
    for g in sorted(range(len(groups)), key=lambda i: -len(groups[i])):
        shift = 0
        while True:
            spots = {((h & _HALF) + shift * (h >> 31 & _HALF | 1)) % _HALF % size for h in groups[g]}
            if len(spots) == len(groups[g]) and not any(taken[s] for s in spots):
                break
            shift += 1
        for s in spots:
            taken[s] = 1
        shifts[g] = shift
    return shifts, size


def row_number(df: DataFrame, source: int) -> Column:
    """The number of each row of a Parquet scan, with the number of its table (0 to 7) in the highest bits."""
    row = F.col("_metadata.row_index") + F.lit(source << (ROW_BITS + FILE_BITS))
    paths = sorted(df.inputFiles())
    if len(paths) <= 1:
        return row
    shifts, size = file_shifts(paths)
    h = F.xxhash64(F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")))
    shift = F.get(F.lit(shifts), F.pmod(h, F.lit(len(shifts))).cast("int"))
    step = F.shiftright(h, 31).bitwiseAND(F.lit(_HALF)).bitwiseOR(F.lit(1))
    file = F.pmod(F.pmod(h.bitwiseAND(F.lit(_HALF)) + shift * step, F.lit(_HALF)), F.lit(size))
    return row + F.shiftleft(file, ROW_BITS)
