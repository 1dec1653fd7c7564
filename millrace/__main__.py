"""Command line: query or describe Parquet files.

    python -m millrace [-q QUERY] [-f json|jsonl|csv] [-limit N] [--schema] [FILE]
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.errors import PySparkException

from millrace.dialect.grammar import parse
from millrace.engine import Engine
from millrace.errors import QueryError
from millrace.session import Settings, build_session
from millrace.sinks import formatter
from millrace.sources.parquet import is_pattern
from millrace.sources.schema_info import schema_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Query Parquet files with a compact SQL dialect.")
    p.add_argument("-q", dest="query", default="", help="query; a file argument takes the place of its FROM table")
    p.add_argument("-f", dest="format", default="jsonl", help="output format: json, jsonl or csv")
    p.add_argument("-limit", "--limit", dest="limit", type=int, default=0, help="most rows to print (0: all), unless the query has a LIMIT")
    p.add_argument("--schema", "-schema", action="store_true", help="print the file's columns instead of rows")
    p.add_argument("file", nargs="?", default="")
    return p


def main(argv: list[str] | None = None, spark=None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    args = parser().parse_args(argv)
    try:
        if args.limit < 0:
            raise QueryError(f"-limit must be non-negative, got {args.limit}")
        if args.schema and args.query:
            raise QueryError("--schema and -q cannot be used together")
        sink = formatter(args.format)
        if not args.file and not args.query:
            raise QueryError("no file given")
        query = parse(args.query) if args.query else None
        if query is None and not args.file:
            raise QueryError("--schema needs a file")
        spark = spark or build_session(Settings(extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}))
        if args.schema:
            if is_pattern(args.file):
                err.write("note: the schema is that of the first file that matches\n")
            sink.write(schema_table(spark, args.file), out)
            return 0
        engine = Engine(spark)
        if query is None:
            df = engine.table(args.file)
        else:
            source = query.source
            if args.file and source.table is not None and source.table not in {c.name for c in query.ctes}:
                query = dataclasses.replace(query, source=dataclasses.replace(source, table=args.file))
            df = engine.run(query)
        if args.limit and (query is None or query.limit is None):
            df = df.limit(args.limit)
        sink.write(df, out)
        return 0
    except (QueryError, PySparkException) as e:
        err.write(f"Error: {str(e).splitlines()[0]}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
