"""Queries from the command line: `python -m annulus list`, `python -m annulus run QUERY FOLDER [OUT]`, `python -m annulus explain QUERY FOLDER`."""

from __future__ import annotations

import argparse

from annulus.plans import catalogue


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="annulus")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name, what in (("run", "show a query's rows, or write them as Parquet"), ("explain", "show a query's plan")):
        one = commands.add_parser(name, help=what)
        one.add_argument("query", choices=sorted(catalogue.queries()))
        one.add_argument("folder")
        if name == "run":
            one.add_argument("out", nargs="?")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = catalogue.queries()[given.query](spark, given.folder)
    if given.command == "explain":
        rows.explain("formatted")
    elif given.out:
        rows.write.parquet(given.out)
    else:
        rows.show(truncate=False)


if __name__ == "__main__":
    main()
