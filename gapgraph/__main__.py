"""Command line: python -m gapgraph analyze | gaps | hypothesize | show | providers | serve."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from gapgraph import report, service
from gapgraph.config import DEFAULT_MODELS, Settings
from gapgraph.errors import GapGraphError
from gapgraph.operators.completion import client_for
from gapgraph.sources.corpus import load_any
from gapgraph.sources.document import read_document, write_document
from gapgraph.visual import to_html


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gapgraph", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("analyze", help="papers (files or one folder) to a graph document")
    c.add_argument("papers", nargs="*")
    c.add_argument("--corpus", help="a folder of .txt files")
    c.add_argument("-o", "--output")
    c.add_argument("--min-confidence", type=float)
    c.add_argument("--hypotheses", type=int, help="also generate so many hypotheses")
    c = commands.add_parser("gaps", help="the best gaps of a document")
    c.add_argument("graph")
    c.add_argument("--top", type=int, default=10)
    c = commands.add_parser("hypothesize", help="hypotheses for a document's gaps")
    c.add_argument("graph")
    c.add_argument("-o", "--output")
    c.add_argument("--top", type=int, default=5)
    c.add_argument("--max", type=int)
    c = commands.add_parser("show", help="a document as an HTML page")
    c.add_argument("graph")
    c.add_argument("-o", "--output")
    commands.add_parser("providers", help="the known providers")
    c = commands.add_parser("serve", help="an HTTP server")
    c.add_argument("--host")
    c.add_argument("--port", type=int)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client=None) -> int:
    args = _parser().parse_args(argv)
    settings = Settings.from_env()
    logging.basicConfig(level=settings.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if args.command == "providers":
        for name, model in DEFAULT_MODELS.items():
            print(f"{'*' if name == settings.provider else ' '} {name}: {settings.model_id if name == settings.provider else model}")
        return 0
    spark = spark or SparkSession.builder.appName("gapgraph").getOrCreate()
    client = client or client_for(settings)
    try:
        if args.command == "analyze":
            if args.min_confidence is not None:
                settings = replace(settings, min_confidence=args.min_confidence)
            document = service.analyze(load_any(spark, [args.corpus] if args.corpus else args.papers), client, settings)
            if args.hypotheses:
                document = service.hypothesize(document, client, settings, args.hypotheses)
            report.summary(document).show(truncate=False)
            report.gaps_report(document, 5).show(truncate=False)
            if args.output:
                write_document(document, args.output)
        elif args.command == "gaps":
            rows = report.gaps_report(read_document(spark, args.graph), args.top)
            print("no gaps") if rows.isEmpty() else rows.show(args.top, truncate=False)
        elif args.command == "hypothesize":
            document = service.hypothesize(read_document(spark, args.graph), client, settings, args.max)
            report.hypotheses_report(document, args.top).show(args.top, truncate=False)
            if args.output:
                write_document(document, args.output)
        elif args.command == "show":
            page = to_html(read_document(spark, args.graph))
            with open(args.output or f"{args.graph.rstrip('/')}.html", "w", encoding="utf-8") as f:
                f.write(page)
        else:
            service.serve(spark, client, replace(settings, api_host=args.host or settings.api_host, api_port=args.port or settings.api_port))
    except (GapGraphError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
