"""Readers' highlights: runs of words (doc_id, id, start, end inclusive, colour, words, note)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEARCH = 400


def resolve(highlights: DataFrame, words: DataFrame) -> DataFrame:
    """``highlights`` with ``at``: where their words are now, the nearest place within 400 words (the earlier of equals), or null.

    A place is looked for where the first word stands: an equi-join on document and word,
    then on each further word, so that nothing is compared with a whole document.
    """
    wanted = highlights.select("doc_id", "id", "start", F.posexplode(F.split("words", " ")).alias("k", "word"))
    size = highlights.select("doc_id", "id", F.size(F.split("words", " ")).alias("size"))
    held = words.select("doc_id", "n", F.col("text").alias("word"))
    hits = wanted.join(held, ["doc_id", "word"]).withColumn("place", F.col("n") - F.col("k")).where(F.abs(F.col("place") - F.col("start")) <= SEARCH)
    whole = hits.groupBy("doc_id", "id", "start", "place").agg(F.count("*").alias("found")).join(size, ["doc_id", "id"]).where("found = size and place >= 0")
    best = whole.groupBy("doc_id", "id").agg(F.min_by("place", F.struct(F.abs(F.col("place") - F.col("start")), "place")).alias("at"))
    return highlights.join(best, ["doc_id", "id"], "left")


def erase(highlights: DataFrame, first: int, last: int) -> DataFrame:
    """``highlights`` without the words first..last; a note stays with the first part that is left."""
    a, b = min(first, last), max(first, last)
    left = F.when(F.col("start") < a, F.struct(F.col("start"), F.least("end", F.lit(a - 1)).alias("end")))
    right = F.when(F.col("end") > b, F.struct(F.greatest("start", F.lit(b + 1)).alias("start"), F.col("end")))
    parts = F.filter(F.array(left, right), lambda p: p.isNotNull())
    rows = highlights.select("*", F.posexplode(parts).alias("__k", "__p"))
    return rows.withColumn("note", F.when(F.col("__k") == 0, F.col("note")).otherwise(F.lit(""))).withColumn("start", F.col("__p.start")).withColumn("end", F.col("__p.end")).drop("__k", "__p")


def add(highlights: DataFrame, new: DataFrame) -> DataFrame:
    """``highlights`` after each document's new one (doc_id, id, start, end, colour, words, note) was put over them.

    The note of a highlight that is covered whole carries over if the new one has none.
    """
    over = new.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    rows = highlights.join(over, "doc_id", "left")
    covered = rows.where("a <= start and end <= b and note <> ''").groupBy("doc_id").agg(F.min_by("note", "start").alias("carried"))
    left = F.when(F.col("a").isNull() | (F.col("start") < F.col("a")), F.struct(F.col("start"), F.when(F.col("a").isNull(), F.col("end")).otherwise(F.least("end", F.col("a") - 1)).alias("end")))
    right = F.when(F.col("end") > F.col("b"), F.struct(F.greatest("start", F.col("b") + 1).alias("start"), F.col("end")))
    kept = rows.select(*highlights.columns, F.posexplode(F.filter(F.array(left, right), lambda p: p.isNotNull())).alias("__k", "__p"))
    kept = kept.withColumn("note", F.when(F.col("__k") == 0, F.col("note")).otherwise(F.lit(""))).withColumn("start", F.col("__p.start")).withColumn("end", F.col("__p.end"))
    put = new.join(covered, "doc_id", "left").withColumn("note", F.when(F.col("note") != "", F.col("note")).otherwise(F.coalesce("carried", F.lit(""))))
    return kept.select(*highlights.columns).unionByName(put.select(*highlights.columns))


def study_sheet(highlights: DataFrame, headings: DataFrame) -> DataFrame:
    """Counts of highlights and notes by colour under the last heading before them (headings: doc_id, n, heading)."""
    marks = highlights.select("doc_id", F.col("start").alias("n"), F.lit(1).alias("side"), "colour", "note", F.lit(None).cast("string").alias("heading"))
    heads = headings.select("doc_id", "n", F.lit(0).alias("side"), F.lit(None).cast("string").alias("colour"), F.lit(None).cast("string").alias("note"), "heading")
    order = W.partitionBy("doc_id").orderBy("n", "side").rowsBetween(W.unboundedPreceding, 0)
    rows = marks.unionByName(heads).withColumn("under", F.last("heading", ignorenulls=True).over(order)).where("side = 1")
    return rows.groupBy("doc_id", F.coalesce("under", F.lit("")).alias("heading"), "colour").agg(F.count("*").alias("marks"), F.count_if(F.trim("note") != "").alias("notes"))


def nearest_word(points: DataFrame, words: DataFrame) -> DataFrame:
    """``points`` (doc_id, page, id, x, y) with the nearest word of their page; a step up or down weighs three times as much."""
    both = points.join(words, ["doc_id", "page"])
    dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1"))
    return both.groupBy("doc_id", "page", "id").agg(F.min_by("n", F.struct(dx * dx + dy * 3 * dy * 3, "n")).alias("word"))
