"""Command line: sources and a query in, results out. Runs under spark-submit or plain python."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine, InvalidQueryError, UnsupportedQueryError
from .plans.parser import PREFIXES
from .results.writers import WRITERS, write
from .sources.base import Source
from .sources.federated import FederatedSource
from .sources.files import read
from .sources.fragments import FragmentSource
from .sources.relational import star_schema
from .sources.triples import TripleSource

LEVELS = {"emergency": 50, "alert": 50, "critical": 50, "error": 40, "warning": 30, "warn": 30, "notice": 20, "info": 20, "debug": 10}


def open_source(spark: SparkSession, name: str, at: str | None = None) -> Source:
    """tables:FOLDER for the driver's tables, http(s):// for paged fragments, else files of triples by extension."""
    if name.startswith("tables:"):
        return star_schema(spark, name.removeprefix("tables:"))
    if name.startswith(("http://", "https://")):
        return FragmentSource(spark, name, on_error="warn_empty", at=at)
    return TripleSource(read(spark, name))


def open_sources(spark: SparkSession, names: list[str], at: str | None = None) -> Source:
    found = [open_source(spark, n, at) for n in names]
    return found[0] if len(found) == 1 else FederatedSource(spark, found)


class CsvFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        cell = lambda x: '"' + str(x).replace('"', '""') + '"' if any(c in str(x) for c in ',"\n') else str(x)
        return ",".join(map(cell, (self.formatTime(record), record.name, record.levelname, record.getMessage())))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="triloom", description="Evaluate a query over one or more sources of triples.")
    p.add_argument("sources", nargs="*", help="sources; the last is the query unless -q or -f is given")
    p.add_argument("-q", metavar="QUERY", help="the query")
    p.add_argument("-f", metavar="FILE", help="file with the query")
    p.add_argument("-c", metavar="FILE", help="JSON file with prefixes and datetime")
    p.add_argument("-t", metavar="TYPE", default="application/json", help="media type of the output")
    p.add_argument("-l", metavar="LEVEL", default="warning", choices=sorted(LEVELS), help="log level")
    p.add_argument("-d", metavar="DATETIME", help="time at which to query archives")
    p.add_argument("--csv", action="store_true", help="log as CSV")
    p.add_argument("--quirks", action="store_true", help="the dialect's deviations instead of SPARQL 1.1")
    p.add_argument("--explain", action="store_true", help="print the plan instead of results")
    p.add_argument("--listformats", action="store_true", help="print the media types of output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    args = parser().parse_args(argv)
    if args.listformats:
        out.write("".join(f"{t}\n" for t in WRITERS))
        return 0
    query = args.q
    if args.f:
        with open(args.f, encoding="utf-8") as f:
            query = f.read()
    elif query is None and args.sources:
        query = args.sources.pop()
        if os.path.exists(query):
            with open(query, encoding="utf-8") as f:
                query = f.read()
    if not query or not args.sources:
        parser().print_usage(sys.stderr)
        return 1
    config = {}
    if args.c:
        with open(args.c, encoding="utf-8") as f:
            config = json.load(f)
    handler = logging.StreamHandler()
    if args.csv:
        handler.setFormatter(CsvFormatter())
    logging.getLogger("triloom").addHandler(handler)
    logging.getLogger("triloom").setLevel(LEVELS[args.l])
    spark = spark or SparkSession.builder.appName("triloom").getOrCreate()
    prefixes = PREFIXES | config.get("prefixes", {})
    try:
        engine = Engine(spark, open_sources(spark, args.sources, args.d or config.get("datetime")), prefixes, "quirks" if args.quirks else "standard")
        if args.explain:
            out.write(engine.explain(query) + "\n")
            return 0
        for chunk in write(engine.sparql(query), args.t, config.get("prefixes")):
            out.write(chunk)
    except (InvalidQueryError, UnsupportedQueryError, ValueError) as e:
        sys.stderr.write(f"ERROR: the query could not start.\n\n{e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
