"""Command line: run query files, ask queries one by one, build stored graphs.

    python -m graphloom.cli batch GRAPH QUERIES [--limit N] [--timeout S] [--repeat R] [--mode M] [--distinct] [--out FILE]
    python -m graphloom.cli ask GRAPH [--out FOLDER]
    python -m graphloom.cli build PREFIX STORE

GRAPH is a stored graph or the prefix of TSV files.  ``batch`` writes ``number, results, milliseconds`` a
line, separated by tabs; a query that fails counts 0 results in 0 ms and its error goes to standard error.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import GraphQueryError, QueryTimeout
from graphloom.plans.graph import PropertyGraph
from graphloom.plans.parser import read_queries
from graphloom.plans.planner import EDGE_SEMANTICS, MODES, match, within
from graphloom.session import build_session
from graphloom.sources import store, tsv


def open_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A stored graph where there is one, else the TSV files of a prefix."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/catalog")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return store.load(spark, path)
    return tsv.load_tsv(spark, path)


def run_batch(graph: PropertyGraph, queries: Iterable[str], *, limit: int = 0, timeout: float = 600.0, repeat: int = 1, mode: str = MODES[0], edge_semantics: str = EDGE_SEMANTICS[0], complain: Callable[[str], None] = lambda text: print(text, file=sys.stderr)) -> Iterator[tuple[int, int, float]]:
    """``(number, results, average milliseconds)`` of each query; parsing and planning count as well."""
    for number, text in enumerate(queries, 1):
        count, spent = 0, 0.0
        try:
            for _ in range(max(1, repeat)):
                start = time.perf_counter()
                count = within(match(graph, text, mode=mode, edge_semantics=edge_semantics, limit=limit or None), timeout)
                spent += time.perf_counter() - start
            yield number, count, 1000 * spent / max(1, repeat)
        except (GraphQueryError, QueryTimeout) as error:
            complain(f"query {number}: {error}")
            yield number, 0, 0.0


def write_summary(rows: Iterable[tuple[int, int, float]], path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        for number, count, ms in rows:
            out.write(f"{number}\t{count}\t{ms:.6f}\n")
            out.flush()


def converse(graph: PropertyGraph, lines: Iterable[str], say: Callable[[str], None] = print, out: str | None = None, shown: int = 10) -> None:
    """Answer queries one by one: the first rows are shown, all of them written to ``out`` if given."""
    for number, line in enumerate(lines):
        text = line.strip()
        if text in ("exit", "quit"):
            return
        if not text:
            continue
        try:
            df = match(graph, text)
            say("\t".join(df.columns))
            for row in df.take(shown):
                say("\t".join("" if v is None else str(v) for v in row))
            if out:
                _write(df, f"{out}/{number}")
        except GraphQueryError as error:
            say(f"error: {error}")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom", description="Pattern queries over property graphs.")
    commands = parser.add_subparsers(dest="command", required=True)
    batch = commands.add_parser("batch")
    batch.add_argument("graph")
    batch.add_argument("queries")
    batch.add_argument("--limit", type=int, default=0)
    batch.add_argument("--timeout", type=float, default=600.0)
    batch.add_argument("--repeat", type=int, default=1)
    batch.add_argument("--mode", choices=MODES, default=MODES[0])
    batch.add_argument("--distinct", action="store_true")
    batch.add_argument("--out", default="summary.tsv")
    ask = commands.add_parser("ask")
    ask.add_argument("graph")
    ask.add_argument("--out")
    build = commands.add_parser("build")
    build.add_argument("prefix")
    build.add_argument("store")
    given = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or build_session(master=os.environ.get("MASTER", "local[*]"))
    if given.command == "build":
        store.build(*tsv.read_tsv(spark, given.prefix), given.store)
    elif given.command == "ask":
        converse(open_graph(spark, given.graph), sys.stdin, out=given.out)
    else:
        rows = run_batch(open_graph(spark, given.graph), read_queries(given.queries), limit=given.limit, timeout=given.timeout, repeat=given.repeat, mode=given.mode, edge_semantics=EDGE_SEMANTICS[given.distinct])
        write_summary(rows, given.out)


if __name__ == "__main__":
    main()
