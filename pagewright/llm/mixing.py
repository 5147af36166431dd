"""Mixing sources to target weights, with DataFrame functions only.

A source's words are its documents' sizes added up. The targets share all words by
the sources' weights, but none is above ``most`` times its source's words; what that
leaves over goes to the others by weight, until none is above. With the level L that
this settles at, target = least(most * words, L * weight); the sources reach their
limits one after the other, so that L rises from its value without limits by one sum
over the sources for each step, until no further source is full. A source's repetition rate is target / words. A document is taken
floor(rate) times and once more if a uniform number hashed from its id and the seed
is below the fraction, so that reruns agree wherever a row is computed.

Scale: the words are counted in the scan, and sums by source are combined before the
shuffle. The sources are numbered in range partitions, each apart, so that no task
holds all of them, and only sums over them reach the driver. Each document meets its
source's row in an equi-join: by broadcast, if the sources have been counted and are
few, or else by source, where those of very many documents are broadcast.

Defined cases: a null text has size 0; null is a source like any other, the last; a
source without words has target 0 and rate 0; repeated rows each give a row, and all
take the same number; rows with a null id share one hash; an empty table gives an
empty result; columns whose names are used here inside are renamed on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialise, met

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) by the MD5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _numbered(total: DataFrame) -> DataFrame:
    """The rows of ``total``, one for each source, with their place ``at`` in the order of sources, from 0."""
    dealt = materialise(total.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    # one row for each partition
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", place).join(F.broadcast(sizes), "part").withColumn("at", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, rows, target) from rows of (source, size).

    The sources take the weights in the order of their code points, null last,
    beginning again as often as needed.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("at") % len(weights) + 1).cast("int"))
    sources = materialise(_numbered(total).withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "weighed")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.lit(level) * F.col("weight")
        taken, open_weight, n = sources.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if n == full or not open_weight:
            break
        level, full = (words - (taken or 0.0)) / open_weight, n
    limit = F.col("most") if not open_weight else F.least("most", F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "rows", limit.cast("double").alias("target"))


def copies(id_col: Column, seed: int) -> Column:
    """Times a document is taken, from the columns target and source_size."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + F.when(uniform(id_col, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _goals(sizes: DataFrame, **how) -> DataFrame:
    """The targets by a key that is never null, as a written table of (key, rows, goal)."""
    goal = F.struct("source", "source_size", "target").alias("__goal")
    return materialise(targets(sizes, **how).select(_key(F.col("source")).alias("__key"), "rows", goal), "targets")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _aimed(rows: DataFrame, source: Column, goal: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` with their source's ``__goal``.

    Up to ``broadcast_rows`` sources, as counted, are sent to every task, so that texts stay
    where they are; more of them are joined by source, the hot ones by a broadcast.
    """
    rows = rows.withColumn("__key", _key(source))
    if goal.count() <= broadcast_rows:
        return rows.join(F.broadcast(goal.drop("rows")), "__key").drop("__key")
    return met(rows, goal, "__key", "rows").drop("__key")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10, broadcast_rows: int = 50_000, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document; taken is in words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    rows = materialise(rows, "sizes")  # counted once, for the sums and for the rows
    both = _aimed(rows, F.col("source"), _goals(rows, **how), broadcast_rows).select("doc_id", "size", F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), seed)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10, broadcast_rows: int = 50_000, **how) -> DataFrame:
    """The documents, each as often as it is taken, with the columns they had."""
    sizes = docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    rows = docs.select(F.struct("*").alias("__doc"))
    both = _aimed(rows, F.col(f"__doc.`{source_col}`"), _goals(sizes, **how), broadcast_rows).select("__doc", F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"))
    times = copies(F.col(f"__doc.`{id_col}`"), seed).cast("int")
    return both.select("__doc", times.alias("__times")).where("__times > 0").select("__doc", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__doc.*")
