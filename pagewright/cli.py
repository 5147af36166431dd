"""``python -m pagewright.cli IN -o OUT -f md``: a folder of Word, EPUB and HTML files to text, Markdown or books."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .settings import PRESETS
from .sinks import FORMATS, export
from .sources.containers import read_files


def main(argv: list[str] | None = None) -> int:
    """0: written; 2: the output is the input, or nothing could be read."""
    ask = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    ask.add_argument("input")
    ask.add_argument("-o", "--output", required=True)
    ask.add_argument("-f", "--format", default="md", choices=sorted(FORMATS))
    ask.add_argument("--preset", choices=sorted(PRESETS), default="Standard")
    args = ask.parse_args(argv)
    if args.output.rstrip("/") == args.input.rstrip("/"):
        print("The output would overwrite the input. Choose another folder.", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    found = read_files(spark, args.input)
    items = found.where("kind not in ('locked', 'unreadable')").withColumn("marker", F.lit("")).withColumnRenamed("path", "doc_id")
    if items.isEmpty():
        print("No readable text was found.", file=sys.stderr)
        return 2
    export(items, args.format).write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
