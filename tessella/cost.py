"""Command line: what watching the assets of a table would cost, by tier.

    python -m tessella.cost assets.parquet --mode high --start 00:00:05 --end 00:01:00 --out costs.parquet

The table (Parquet, or JSON lines where the name ends in .json or .jsonl) has series_id, duration_s, width and height. Rows are estimated in Spark and written
with ``--out``; what is printed is one line for each tier, or JSON with ``--json``.
"""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import planning
from tessella.operators.requests import LABEL


def _seconds(label: str) -> float:
    if not re.fullmatch(LABEL[1:-1], label):
        raise argparse.ArgumentTypeError(f"{label!r} is not HH:MM:SS")
    hours, minutes, seconds = label.split(":")
    return int(hours) * 3600 + int(minutes) * 60 + float(seconds)


def _above(kind: type):
    def read(text: str):
        value = kind(text)
        if not value > 0:
            raise argparse.ArgumentTypeError("must be above zero")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessella.cost", description="Token costs of watching the assets of a table.")
    out.add_argument("table")
    out.add_argument("--mode", choices=[t[0] for t in planning.TIERS], help="one tier; all are told otherwise")
    out.add_argument("--start", type=_seconds, default=0.0, metavar="HH:MM:SS")
    out.add_argument("--end", type=_seconds, metavar="HH:MM:SS")
    out.add_argument("--cap", type=_above(int), default=50000, help="tokens that one call may return")
    out.add_argument("--out", metavar="FOLDER", help="write a row for each asset and tier as Parquet")
    out.add_argument("--json", action="store_true")
    return out


def sliced(assets: DataFrame, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """The assets with the length of what lies between two times; those that end before it, or have no length, have no row. An end that is not after the start counts as none."""
    end = F.col("duration_s") if end_s is None or end_s <= start_s else F.least(F.col("duration_s"), F.lit(float(end_s)))
    return assets.where("duration_s IS NOT NULL").withColumn("duration_s", end - F.lit(float(start_s))).where("duration_s > 0")


def totals(costs: DataFrame) -> DataFrame:
    """(mode, n_assets, n_over_cap, tokens_per_call (mean), tokens_thorough, n_compacting) by rank of the tiers."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("long")
    made = costs.groupBy("rank", "mode").agg(F.count(F.lit(1)).alias("n_assets"), F.count_if("exceeds_cap").alias("n_over_cap"), F.floor(F.avg("tokens_per_call") + 0.5).alias("tokens_per_call"), whole("tokens_thorough").alias("tokens_thorough"), F.count_if("compacts").alias("n_compacting"))
    return made.orderBy("rank").drop("rank")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella.cost").getOrCreate()
    assets = spark.read.json(args.table) if args.table.endswith((".json", ".jsonl")) else spark.read.parquet(args.table)
    missing = {"series_id", "duration_s", "width", "height"} - set(assets.columns)
    if missing:
        print(f"the table has no {', '.join(sorted(missing))}", file=sys.stderr)
        return 1
    costs = planning.cost_estimates(sliced(assets, args.start, args.end), args.cap)
    if args.mode:
        costs = costs.where(F.col("mode") == args.mode)
    if args.out:
        costs.write.mode("errorifexists").parquet(args.out)
        costs = spark.read.parquet(args.out)
    rows = [r.asDict() for r in totals(costs).collect()]  # one row for each tier
    if args.json:
        print(json.dumps(rows))
    else:
        for r in rows:
            print(f"{r['mode']:>5}: {r['n_assets']} assets, {r['tokens_per_call']} tokens a call, {r['tokens_thorough']} for full coverage, {r['n_over_cap']} over the cap of {args.cap}, {r['n_compacting']} beyond one conversation")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
