"""Command line: ``python -m lakeloom.cli create|get|audit LOCATION``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from .operators import audit
from .session import configure_spark
from .table import create_table, open_table


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeloom", description="Create, show and audit snapshot tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("create", help="create an empty table")
    make.add_argument("location")
    make.add_argument("--schema", required=True, help='columns as DDL, e.g. "id long not null, name string"')
    make.add_argument("--partition-by", nargs="*", default=[], metavar="COLUMN[:TRANSFORM]")
    show = commands.add_parser("get", help="show a table's state")
    show.add_argument("location")
    check = commands.add_parser("audit", help="write an audit report")
    check.add_argument("location")
    check.add_argument("--format", choices=("json", "markdown", "pdf"), default="markdown")
    check.add_argument("--output")
    got = parser.parse_args(args)
    spark = configure_spark(spark or SparkSession.builder.appName("lakeloom").getOrCreate())

    if got.command == "create":
        schema = StructType.fromDDL(got.schema)
        by = [tuple(p.split(":", 1)) if ":" in p else p for p in got.partition_by]
        print(create_table(spark, got.location, schema, partition_by=by or None))
        return 0
    table = open_table(spark, got.location)
    if got.command == "get":
        print(table)
        for name, f in table.schema.all_fields():
            print(f"  {f.id} {name} {f.type['type']}{' required' if f.required else ''}")
        return 0
    data = {"json": audit.to_json, "markdown": audit.to_markdown, "pdf": audit.to_pdf}[got.format](table)
    if got.output:
        with open(got.output, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    elif isinstance(data, bytes):
        sys.stdout.buffer.write(data)
    else:
        print(data)
    return 0


if __name__ == "__main__":
    sys.exit(main())
