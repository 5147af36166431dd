"""How far to trust a conversion: words to check, ratings of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .links import without_overlap

# Limits of confidence and of the shares that lower a level, and what ends a sentence.
UNCLEAR, UNKNOWN = 50, 95
SHARES = (0.05, 0.12, 0.30)
FORMULAS, SPLIT = 3, 0.15
OUTER = ".,;:!?()[]\"'“”‘’"
TERMINAL = r"[.!?:;”\"’)\]]$"
STATS = ("words", "ocr_words", "unsure", "formulas", "breaks", "split", "unreadable")


def unsure_words(words: DataFrame, lexicon: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """``words`` (doc_id, seq, start, end, text, confidence) that may be misread, with a reason.

    ``lexicon`` has the known words in lower case; words inside a ``fixed`` span (doc_id,
    seq, start, end) are no longer in doubt. Only words of middling confidence are looked up.
    """
    bare = F.btrim("text", F.lit(OUTER))
    words = words.where("confidence >= 0").withColumn("bare", bare)
    unclear = words.where(F.col("confidence") < UNCLEAR).withColumn("reason", F.lit("unclear"))
    asked = words.where((F.col("confidence") >= UNCLEAR) & (F.col("confidence") < UNKNOWN) & (F.length("bare") >= 3) & F.col("bare").rlike(r"^\p{L}+$"))
    known = lexicon.select(F.col("word").alias("known")).distinct()
    unknown = asked.join(known, F.lower("bare") == F.col("known"), "left_anti").withColumn("reason", F.lit("unknown"))
    found = unclear.unionByName(unknown).drop("bare")
    return without_overlap(found, fixed, ["doc_id", "seq"]) if fixed is not None else found


def level(ocr_words: Column, unsure: Column, ocr: Column, formulas: Column, split: Column, unusual: Column) -> Column:
    """struct<level, reasons array<struct<code, number>>> for the signals of a page or document."""
    share = F.when(ocr_words > 0, unsure / ocr_words).otherwise(0.0)
    drops = sum((F.when(share > s, 1).otherwise(0) for s in SHARES), F.lit(0))
    flag = lambda c: F.when(c, 1).otherwise(0)
    out = F.lit(5) - F.when(ocr, 1 + drops).otherwise(0) - flag(formulas >= FORMULAS) - flag(split >= SPLIT) - flag(unusual)
    why = lambda c, code, n: F.when(c, F.struct(F.lit(code).alias("code"), n.cast("double").alias("number")))
    reasons = F.array(
        why(ocr, "ocr", F.lit(0)),
        why(ocr & (unsure > 0), "unsure", F.bround(100 * share, 0)),
        why(formulas >= FORMULAS, "formulas", F.bround(formulas.cast("double"), 0)),
        why(split >= SPLIT, "split", F.bround(100 * split, 0)),
        why(unusual, "layout", F.lit(0)),
    )
    return F.struct(F.greatest(F.lit(1), out).alias("level"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def split_breaks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, breaks, split) from paragraphs (doc_id, seq, page, text) that aren't blank."""
    order = W.partitionBy("doc_id").orderBy("seq")
    rows = paragraphs.where("trim(text) <> ''").withColumn("following", F.lead("text").over(order)).where("following is not null")
    cut = ~F.trim("text").rlike(TERMINAL) & F.trim("following").rlike(r"^\p{Ll}")
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("breaks"), F.count_if(cut).alias("split"))


def rate_pages(stats: DataFrame, pages: DataFrame) -> DataFrame:
    """``stats`` (doc_id, page, STATS) with ``pages`` (doc_id, page, ocr, unusual, source_page): (doc_id, page, source_page, level, reasons).

    A page without words has no rating, unless text is shown there as a picture.
    """
    rows = stats.join(pages, ["doc_id", "page"], "left")
    share = F.when(F.col("breaks") > 0, F.col("split") / F.col("breaks")).otherwise(0.0)
    found = level(F.col("ocr_words"), F.col("unsure"), F.coalesce("ocr", F.lit(False)), F.col("formulas"), share, F.coalesce("unusual", F.lit(False)))
    pictured = F.struct(F.lit(1).alias("level"), F.array(F.struct(F.lit("pictured").alias("code"), F.lit(0.0).alias("number"))).alias("reasons"))
    rows = rows.withColumn("rating", F.when(F.col("words") > 0, found).when(F.col("unreadable") > 0, pictured)).where("rating is not null")
    source = F.when(F.col("source_page") >= 0, F.col("source_page")).otherwise(F.col("page"))
    return rows.select("doc_id", "page", source.alias("source_page"), "rating.level", "rating.reasons")


def by_source_page(ratings: DataFrame) -> DataFrame:
    """The lowest rating of the pages that come from one page of the original; the first of equals."""
    first = F.min_by(F.struct("level", "reasons"), F.struct("level", "page"))
    return ratings.groupBy("doc_id", "source_page").agg(first.alias("r")).select("doc_id", "source_page", "r.level", "r.reasons")


def rate_documents(stats: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, level, reasons): the same signals over all pages, capped by pictured and weak ones."""
    total = stats.groupBy("doc_id").agg(F.greatest(F.lit(1), F.count_if(F.col("words") > 0)).alias("n"), *(F.sum(c).alias(c) for c in STATS[1:6]))
    kinds = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("ocr").alias("ocr"), F.count_if("unusual").alias("unusual"))
    rated = rate_pages(stats, pages)
    pictured = F.count_if(F.get("reasons", F.lit(0))["code"] == "pictured")
    weak = rated.groupBy("doc_id").agg(F.count("*").alias("rated"), pictured.alias("pictured"), F.count_if(F.col("level") <= 2).alias("weak"))
    rows = total.join(kinds, "doc_id", "left").join(weak, "doc_id", "left").na.fill(0)
    most = F.greatest(F.lit(1), F.col("pages"))
    share = F.when(F.col("breaks") > 0, F.col("split") / F.col("breaks")).otherwise(0.0)
    first = level(F.col("ocr_words"), F.col("unsure"), F.col("ocr") * 2 >= most, F.col("formulas") / F.col("n"), share, F.col("unusual") * 2 > most)
    rows = rows.withColumn("r", first)
    add = lambda code, n: F.concat(F.col("r.reasons"), F.array(F.struct(F.lit(code).alias("code"), n.cast("double").alias("number"))))
    low = (F.col("pictured") > 0) & (F.col("pictured") * 4 >= F.greatest(F.lit(1), F.col("rated")))
    rows = rows.withColumn("r", F.when(low, F.struct(F.least("r.level", F.lit(2)).alias("level"), add("pictured", F.col("pictured")).alias("reasons"))).otherwise(F.col("r")))
    few = (F.col("weak") > 0) & (F.col("weak") * 10 >= F.col("rated")) & (F.col("r.level") > 3)
    rows = rows.withColumn("r", F.when(few, F.struct(F.lit(3).alias("level"), F.array(F.struct(F.lit("weak_pages").alias("code"), F.col("weak").cast("double").alias("number"))).alias("reasons"))).otherwise(F.col("r")))
    return rows.select("doc_id", "r.level", "r.reasons")


def document_kind(pages: DataFrame) -> DataFrame:
    """(doc_id, kind): "text" if all pages are, "scanned" if none is anything else, or "mixed"."""
    kinds = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    text = F.col("kinds") == F.array(F.lit("text"))
    return kinds.select("doc_id", F.when(text, "text").when(F.forall("kinds", lambda k: k == "scanned"), "scanned").otherwise("mixed").alias("kind"))
