"""Joins between texts, marks and corrections.

Spans meet by overlap in an equi-join on their keys and on buckets of 64 characters;
a span is put into every bucket that it touches, so no pair of a bucket is missed and
nothing is compared with all of a document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import citations as C

BUCKET = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / BUCKET))))


def without_overlap(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those that overlap one of ``others`` with the same keys."""
    key = F.struct(*keys)
    rows = rows.withColumn("__row", F.struct(*rows.columns))
    a = _bucketed(rows.select(key.alias("k"), "start", "end", "__row")).alias("a")
    b = _bucketed(others.select(key.alias("k"), "start", "end")).alias("b")
    meet = (F.col("a.k") == F.col("b.k")) & (F.col("a.__bucket") == F.col("b.__bucket")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    hit = a.join(b, meet, "left_semi").select("__row").distinct().alias("h")
    return rows.alias("r").join(hit, F.col("r.__row") == F.col("h.__row"), "left_anti").drop("__row")


def effective_corrections(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Applied corrections; those by hand replace all others on the same text."""
    live = corrections.where("status in ('auto', 'accepted')")
    hand = live.where("source in ('user', 'check')")
    return hand.unionByName(without_overlap(live.where("source not in ('user', 'check')"), hand, keys))


def match_references(items: DataFrame, references: DataFrame) -> DataFrame:
    """``items`` (doc_id, item) with the index of the one reference (doc_id, idx, text) each means, or -1.

    The surname must be a word in a reference's first 120 characters and the year be in
    it, not as a part of a longer number; of several, the one that begins with the surname is meant, if it is the only one.
    References are joined by document and year, so only those of a year are compared.
    """
    wanted = items.withColumn("surname", C.surname(F.col("item"))).withColumn("year", C.year(F.col("item")))
    years = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?<![0-9])(?=({C.YEAR})(?![0-9]))"), F.lit(1)))
    held = references.select(F.col("doc_id").alias("ref_doc"), "idx", "text", F.explode(F.array_distinct(F.concat(years, F.transform(years, lambda y: F.regexp_replace(y, "[a-z]$", ""))))).alias("ref_year"))
    quoted = F.concat(F.lit(r"\Q"), F.col("surname"), F.lit(r"\E"))
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    first = F.concat(F.lit(r"^[^\p{L}\p{N}_]*(?:\[[0-9]+\]\s*|[0-9]+\.\s*)?"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    fits = (F.col("doc_id") == F.col("ref_doc")) & (F.col("year") == F.col("ref_year")) & (F.col("surname") != "") & F.expr("true")
    pairs = wanted.join(held, fits).where(F.regexp_like(F.substring("text", 1, 120), word))
    found = pairs.groupBy("doc_id", "item").agg(F.collect_set("idx").alias("all"), F.collect_set(F.when(F.regexp_like("text", first), F.col("idx"))).alias("first"))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size("first") == 1, F.get("first", F.lit(0))).otherwise(F.lit(-1))
    found = found.select("doc_id", "item", one.alias("reference"))
    return items.join(found, ["doc_id", "item"], "left").withColumn("reference", F.coalesce("reference", F.lit(-1).cast("long")))


def number_items(rows: DataFrame, doc: str, n_references: int | Column) -> DataFrame:
    """(doc, item, number): an item's reference if it has one, else the next number after the list, by first place."""
    first = rows.groupBy(doc, "item").agg(F.min("seq").alias("first"), F.min("reference").alias("reference"))
    extra = F.row_number().over(W.partitionBy(doc, F.col("reference").isNull()).orderBy("first", "item"))
    after = F.lit(n_references) if isinstance(n_references, int) else n_references
    return first.select(doc, "item", F.coalesce("reference", (after + extra).cast("long")).alias("number"))


def notes_of_markers(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """``marks`` (doc, page, label) with the first note of their label on the page or, failing that, the next one.

    Both joins are merges: notes made by exploding are taken for far fewer than they are, and
    would be gathered by the driver to be broadcast.
    """
    order = W.partitionBy("doc", "page", "label").orderBy("note")
    firsts = notes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("doc", "page", "label", "note")
    near = firsts.select("doc", "page", "label", F.col("note").alias("here"))
    after = firsts.select("doc", (F.col("page") - 1).alias("page"), "label", F.col("note").alias("later"))
    both = marks.join(near.hint("merge"), ["doc", "page", "label"], "left").join(after.hint("merge"), ["doc", "page", "label"], "left")
    return both.withColumn("note", F.coalesce("here", "later")).drop("here", "later")


def carry_decisions(fresh: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """New corrections with the status that the same correction was given before."""
    decided = earlier.where("status in ('accepted', 'rejected')").select(*keys, F.col("status").alias("decided")).dropDuplicates(keys)
    return fresh.join(decided, keys, "left").withColumn("status", F.coalesce("decided", "status")).drop("decided")


def map_equal_blocks(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, old_id, new_id): the k-th copy of a text before and after."""
    nth = F.row_number().over(W.partitionBy(doc, "text").orderBy("seq"))
    a = old.where("text <> ''").select(doc, "text", nth.alias("k"), F.col("block_id").alias("old_id"))
    b = new.where("text <> ''").select(doc, "text", nth.alias("k"), F.col("block_id").alias("new_id"))
    return a.join(b, [doc, "text", "k"]).select(doc, "old_id", "new_id")


def covers_more(inner: str, outer: str, share: float) -> Column:
    """Whether box ``outer`` covers more than ``share`` of box ``inner`` (aliases with x0, y0, x1, y1)."""
    c = lambda side, k: F.col(f"{side}.{k}")
    wide = F.least(c(inner, "x1"), c(outer, "x1")) - F.greatest(c(inner, "x0"), c(outer, "x0"))
    high = F.least(c(inner, "y1"), c(outer, "y1")) - F.greatest(c(inner, "y0"), c(outer, "y0"))
    own = (c(inner, "x1") - c(inner, "x0")) * (c(inner, "y1") - c(inner, "y0"))
    return (wide > 0) & (high > 0) & (own > 0) & (wide * high > own * share)


def popups(markers: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, id, entries): the references that a bracketed marker (doc_id, id, spec) names, ranges under 30 spelled out."""
    asked = markers.select("doc_id", "id", F.posexplode(C.numbers(F.col("spec"), 30)).alias("k", "number"))
    hits = asked.join(references.select("doc_id", "number", "text"), ["doc_id", "number"])
    entry = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("text"))
    listed = hits.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("x"))
    return listed.select("doc_id", "id", F.transform("x", lambda v: v["e"]).alias("entries"))


def confidence_at(places: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` (keys, at) with the confidence of the first range (keys, start, end, confidence) that holds them, or null.

    Of a key's ranges by start, the first that holds a place is the first that ends behind it:
    so each range answers from the farthest end before it up to its own, ranges within
    earlier ones answer nothing, and a place meets the last answer that begins at or before
    it. No row is made more than once, however long the ranges are.
    """
    order = W.partitionBy(*keys).orderBy("start", "confidence")
    reach = ranges.where("start < end").withColumn("__reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    answers = reach.where(F.col("__reach").isNull() | (F.col("end") > F.col("__reach")))
    answer = F.struct(F.col("end").alias("end"), F.col("confidence").alias("confidence"))
    answers = answers.select(*keys, F.greatest("start", "__reach").alias("__at"), F.lit(0).alias("__asks"), answer.alias("__answer"))
    asked = places.select(*keys, F.col("at").alias("__at"), F.lit(1).alias("__asks"), F.struct(*places.columns).alias("__place"))
    both = answers.unionByName(asked, allowMissingColumns=True)
    last = F.last("__answer", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__at", "__asks").rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("__last", last).where("__asks = 1")
    named = reduce(and_, (F.col(k).isNotNull() for k in keys))  # here, not above, so that ranges and places made of the same rows share their shuffle
    held = F.when(named & (F.col("__at") < F.col("__last.end")), F.col("__last.confidence"))
    return met.select(*(F.col("__place").getField(c).alias(c) for c in [*keys, "at", *(c for c in places.columns if c not in (*keys, "at"))]), held.alias("confidence"))


def best_two(candidates: DataFrame) -> DataFrame:
    """(id, word, confidence): the candidate (id, word, score, distance, confidence) of least score, less sure if another is near."""
    order = W.partitionBy("id").orderBy("score", "distance", "word")
    rows = candidates.select("*", F.row_number().over(order).alias("rank"), F.lead("score").over(order).alias("next")).where("rank = 1")
    margin = F.col("next") - F.col("score")
    less = F.when(margin < 0.15, 0.3).when(margin < 0.5, 0.1).otherwise(0.0)
    return rows.select("id", "word", F.greatest(F.lit(0.05), F.col("confidence") - less).alias("confidence"))


def same_symbols(a: Column, b: Column) -> Column:
    """Whether two texts have the same signs the same number of times, white space aside."""
    signs = lambda t: F.array_sort(F.split(F.regexp_replace(t, r"\s", ""), ""))
    return signs(a) == signs(b)
