"""List the batches of a data directory, or run queries over it and write their rows as Parquet.

    python -m tallyweave list DIR [--state STATE ...]
    python -m tallyweave run DIR OUT [QUERY ...]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyweave.plans import catalog
from tallyweave.sources.tables import project


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    lists = commands.add_parser("list")
    lists.add_argument("folder")
    lists.add_argument("--state", action="append")
    runs = commands.add_parser("run")
    runs.add_argument("folder")
    runs.add_argument("out")
    runs.add_argument("query", nargs="*")
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tallyweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.command == "list":
        batches = project(spark, asked.folder, "batches")
        if asked.state:
            batches = batches.filter(F.col("state").isin([s.upper() for s in asked.state]))
        ids = [r[0] for r in batches.orderBy("received_at", "batch_id").select("batch_id").toLocalIterator()]
        print(json.dumps({"batches": ids, "count": len(ids)}))
        return 0
    known = catalog.queries()
    unknown = sorted(set(asked.query) - set(known))
    if unknown:
        print(json.dumps({"ok": False, "error": f"unknown queries {unknown}"}), file=sys.stderr)
        return 1
    done = {}
    for name in asked.query or sorted(known):
        known[name](spark, asked.folder).write.mode("overwrite").parquet(f"{asked.out}/{name}")
        done[name] = spark.read.parquet(f"{asked.out}/{name}").count()
    print(json.dumps({"ok": True, "rows": done}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
