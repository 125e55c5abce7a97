"""python -m spanloom --tables DIR --out DIR: run queries and write their rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanloom.config import arguments
from spanloom.plans.queries import queries


def main() -> None:
    args, found = arguments(), queries()
    unknown = set(args.query) - set(found)
    if unknown:
        raise SystemExit(f"no such query: {', '.join(sorted(unknown))}")
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    for name in args.query or sorted(found):
        found[name](spark, args.tables).write.mode("overwrite").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
