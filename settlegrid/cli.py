"""Command line: ``run``, ``merge``, ``status``, ``export`` over a results store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from settlegrid.operators.windows import SCHEMA, indicators
from settlegrid.session import build_session
from settlegrid.sources.results import ResultStore, status_counts


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code 1 if any window failed."""
    parser = argparse.ArgumentParser(prog="settlegrid")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="indicators of windows whose features are in a cache")
    run.add_argument("--features", required=True, help="Parquet of loc_key, lat, lon, id, geometry, width")
    run.add_argument("--half", type=float, default=1000.0)
    run.add_argument("--force", action="store_true", help="also windows that are done")
    merge = commands.add_parser("merge", help="take the rows of another store")
    merge.add_argument("--other", required=True)
    export = commands.add_parser("export")
    export.add_argument("--csv", required=True)
    commands.add_parser("status")
    for p in commands.choices.values():
        p.add_argument("--store", required=True)
    args = parser.parse_args(argv)
    spark = spark or build_session()
    store = ResultStore(spark, args.store, ["loc_key"], SCHEMA)
    if args.command == "run":
        features = spark.read.parquet(args.features)
        if not args.force:
            features = features.join(store.done_keys(), "loc_key", "left_anti")
        store.upsert(indicators(features, args.half))
        return int(store.read().where("status = 'failed'").limit(1).count() > 0)
    if args.command == "merge":
        before, after = store.merge(ResultStore(spark, args.other, ["loc_key"], SCHEMA).read())
        print(f"{before} rows, now {after}")
    elif args.command == "status":
        for row in status_counts(store.read()).orderBy("status").collect():
            print(row["status"], row["n"])
    else:
        store.read().select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in store.read().dtypes)).coalesce(1).write.mode("overwrite").option("header", True).csv(args.csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())
