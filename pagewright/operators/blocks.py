"""Documents as ordered blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the rows of one in a single file are dealt out, as its one piece would be one task's."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism) if len(rows.inputFiles()) == 1 else rows


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, text): every line of a document is a block."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, computed once and written into the folder of ``spark.checkpoint.dir``; a lost executor loses none of it.

    Where the session names no folder, a folder of this machine is used if it has no other.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file:///tmp/checkpoints")
    return rows.checkpoint()
