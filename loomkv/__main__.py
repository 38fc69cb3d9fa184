"""python -m loomkv --job wordcount|sumbykey|identity --input PATH --output DIR [--num-reducers N] [--codec gzip]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomkv.operators import jobs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomkv", description="Runs a job over text files.")
    p.add_argument("--job", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--num-reducers", type=int, default=1)
    p.add_argument("--codec", default="", help="none or gzip")
    p.add_argument("--local", action="store_true", help="run in this process on all cores")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName(f"loomkv {a.job}").config("spark.sql.session.timeZone", "UTC")
    try:
        jobs.run_job((builder.master("local[*]") if a.local else builder).getOrCreate(), a.job, a.input, a.output, a.num_reducers, a.codec)
    except ValueError as e:
        print(f"Job failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
