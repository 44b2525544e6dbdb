"""Command line: `python -m permway site|report|unread|golden --data-dir DIR`."""

import argparse
import datetime as dt
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.functions.causes import with_reading
from permway.operators import fold, golden, ingest, metrics
from permway.plans import report
from permway.sources.files import matches
from permway.sources.shared import release


def _notices(runs: DataFrame) -> DataFrame:
    seen = ingest.items(ingest.good_runs(runs), ["seq", "fetched_at_utc"]).withColumnRenamed("fetched_at_utc", "first_seen")
    return ingest.distinct_notices(seen.withColumn("seq", F.struct("seq", "item_pos")), "seq")


def _site(runs: DataFrame, args: argparse.Namespace) -> int:
    seen = ingest.sightings(runs, ["seq"])
    seen = seen.withColumn("seq", F.concat_ws("/", "seq.path", F.lpad(F.col("seq.block").cast("string"), 20, "0"), F.lpad(F.col("seq.line").cast("string"), 20, "0"), F.lpad(F.col("item_pos").cast("string"), 10, "0")))
    horizon = ingest.horizon(runs)
    first = ingest.timed_runs(runs).agg(F.min("seen_at")).first()[0]
    start = args.start or (first.strftime("%Y-%m-%d %H:%M:%S") if first else None)
    if start is None:
        print("no successful runs", file=sys.stderr)
        return 1
    now = dt.datetime.now(tz=dt.UTC)
    size, text = report.write_site(report.Corpus(fold.disruptions(seen), horizon, start, now), args.out)
    print(text)
    return int(size > report.BUDGET_BYTES)


def _reports(runs: DataFrame, args: argparse.Namespace) -> int:
    notices = _notices(runs)
    if notices.isEmpty():
        print(f"no notices in {args.data_dir}", file=sys.stderr)
        return 1
    read = with_reading(notices)
    if args.command == "report":
        for r in read.orderBy("first_seen", "head", "text").toLocalIterator():
            print(f"{r.sightings:6} {r.head} | {', '.join(c.label + ' (' + c.role + ')' for c in r.causes) or 'nothing stated'}")
        metrics.category_histogram(read).orderBy(F.desc("n"), "category").show(truncate=False)
        metrics.family_histogram(read).orderBy(F.desc("n"), "family").show(truncate=False)
    elif args.command == "unread":
        for r in metrics.unread_histogram(read).orderBy(F.desc("n"), "clause").toLocalIterator():
            print(f"{r.n:6} {r.clause}")
        for r in metrics.silent(read).orderBy("head", "text").toLocalIterator():
            print(f"silent {r.head} | {r.text}")
    else:
        stored, current = golden.load(runs.sparkSession, args.golden), golden.build(notices)
        for r in golden.differences(stored, current).orderBy("head", "text").toLocalIterator():
            print(f"moved  {r.head} | {r.text}")
        print(f"gained {golden.gained(stored, current).count()}")
        golden.dump(golden.merge(stored, current), args.golden)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="permway")
    parser.add_argument("command", choices=["site", "report", "unread", "golden"])
    parser.add_argument("--data-dir", default=os.environ.get("PERMWAY_DATA_DIR", "."))
    parser.add_argument("--out", default="out/site")
    parser.add_argument("--golden", default="golden.json")
    parser.add_argument("--start", help="first instant of collection, UTC; by default that of the first poll")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("permway").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not matches(spark, f"{args.data_dir}/raw/messages-*.jsonl"):
        print(f"no log in {args.data_dir}/raw", file=sys.stderr)
        return 1
    runs = ingest.read_log(spark, args.data_dir)
    try:
        return _site(runs, args) if args.command == "site" else _reports(runs, args)
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
