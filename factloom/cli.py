"""Commands: audit of a file tree and its packages, and the gate over a corpus of pairs. For spark-submit, or python -m factloom.cli."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators import audit, gate
from factloom.sources import documents, trees


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("audit", help="licences, pictures and secrets; ends with 1 if something is found")
    a.add_argument("--root", default=".")
    a.add_argument("--packages", help="a JSON list of packages: Name, Version, License")
    g = commands.add_parser("gate", help="verdicts of a JSON-lines corpus of pairs")
    g.add_argument("pairs")
    g.add_argument("--ref-date", required=True, help="yyyy-mm-dd, from which days are counted")
    g.add_argument("--out", help="a folder for the judged pairs, as Parquet; without it their numbers are shown")
    return parser


def main(argv: list[str] | None = None) -> int:
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "audit":
        packages = documents.read_packages(spark, given.packages) if given.packages else spark.createDataFrame([], "Name string, Version string, License string")
        found = audit.audit(packages, trees.read_tree(spark, given.root))
        found.orderBy("kind", "detail").show(1000, truncate=False)
        return int(not found.isEmpty())
    judged = gate.verified(documents.read_pairs(spark, given.pairs).withColumn("ref_date", F.to_date(F.lit(given.ref_date))))
    if given.out:
        judged.write.mode("overwrite").parquet(given.out)
    else:
        judged.groupBy("verdict").count().orderBy("verdict").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
