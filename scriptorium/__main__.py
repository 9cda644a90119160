"""Catalogue records from the command line: template, process, validate, stats and schema."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .functions import values
from .operators import catalogue_records as records
from .sources import readers, sinks


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV with a header or of a JSON array, all fields strings."""
    if path.lower().endswith(".json"):
        return readers.json_records(spark, path, records.SCHEMA)
    header = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False).columns
    return readers.strings_csv(spark, path, header)


def _template(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.write_csv(records.template(spark), a.output, quote_all=True)
    return 0


def _process(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = records.enhance(_records(spark, a.input), fill_defaults=not a.no_defaults, normalize_names=a.normalize_names)
    sinks.write_csv(records.ordered_for_export(rows), a.output, quote_all=True)
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    checked = records.validate(_records(spark, a.input))
    totals = records.summary(checked).first()
    print(f"total {totals.total}, valid {totals.valid}, invalid {totals.invalid}, with warnings {totals.with_warnings}")
    for r in records.details(checked).orderBy("local_identifier", "kind", "position").limit(a.details).collect():
        print(f"{r.local_identifier}: {r.kind}: {r.message}")
    if a.report:
        sinks.write_json(records.details(checked), a.report)
    return 1 if totals.invalid and a.strict else 0


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    profiled = records.profile(_records(spark, a.input))
    for r in records.top_fields(profiled, a.top).collect():
        print(f"{r.field}: {r.populated} of {r.total} ({r.percentage:.1f} %)")
    print("empty:", ", ".join(r.field for r in profiled.where(F.col("populated") == 0).orderBy("field").collect()) or "none")
    return 0


def _schema(spark: SparkSession | None, a: argparse.Namespace) -> int:
    for f in values.FIELDS:
        print(f + (" (required)" if f in values.REQUIRED_FIELDS else ""))
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    """Runs a command; the exit code is 1 for a strict validation that found invalid records."""
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    p.add_argument("--master", default=None, help="Spark master; by default that of the environment")
    commands = p.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    command("template", _template, ("output", {}))
    command("process", _process, ("input", {}), ("output", {}), ("--no-defaults", {"action": "store_true"}), ("--normalize-names", {"action": "store_true"}))
    command("validate", _validate, ("input", {}), ("--details", {"type": int, "default": 10}), ("--report", {}), ("--strict", {"action": "store_true"}))
    command("stats", _stats, ("input", {}), ("--top", {"type": int, "default": 10}))
    command("schema", _schema)
    a = p.parse_args(argv)
    return a.run(None if a.run is _schema else session.build(a.master), a)


if __name__ == "__main__":
    sys.exit(main())
