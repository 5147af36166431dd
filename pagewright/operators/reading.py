"""Reading aloud and findings: places of sentences, words kept, answers that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .links import without_overlap

FINDINGS = ("word", "scan", "furniture", "heading", "not_heading", "order")


def first_sentence_on(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, sentence): the first sentence of words (doc_id, sentence, page) that has one on the page or after it, else the last."""
    ends = words.groupBy("doc_id", "sentence").agg(F.max("page").alias("until"))
    last = ends.groupBy("doc_id").agg(F.max("sentence").alias("last"))
    first = pages.join(ends, "doc_id").where("until >= page").groupBy("doc_id", "page").agg(F.min("sentence").alias("first"))
    return pages.join(last, "doc_id").join(first, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("first", "last").alias("sentence"))


def source_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page) with ``source``: the original's page, counted from 1, or their own where it isn't known."""
    known = pages.where("source_page >= 0").select("doc_id", "page", "source_page")
    return blocks.join(known, ["doc_id", "page"], "left").withColumn("source", F.coalesce("source_page", "page") + 1).drop("source_page")


def span_at(places: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n, start, end): the span (inclusive) that holds word n, or the word alone."""
    hit = places.join(spans, "doc_id").where("start <= n and n <= end").groupBy("doc_id", "n").agg(F.min(F.struct("start", "end")).alias("s"))
    return places.join(hit, ["doc_id", "n"], "left").select("doc_id", "n", F.coalesce("s.start", "n").alias("start"), F.coalesce("s.end", "n").alias("end"))


def kept_words(words: DataFrame, cited: DataFrame) -> DataFrame:
    """Words (doc_id, sentence, k, text, start, end) outside spans (doc_id, sentence, start, end), with their places in what is left."""
    kept = without_overlap(words, cited, ["doc_id", "sentence"])
    order = W.partitionBy("doc_id", "sentence").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return kept.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)))


def held_findings(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Answers (doc_id, part, b, t, q, ...) that name a block of their part (doc_id, part, b, text) and quote it, each once."""
    flat = F.trim(F.regexp_replace("q", r"\s+", " "))
    rows = answers.withColumn("t", F.lower(F.trim("t"))).withColumn("q", flat).where(F.col("t").isin(*FINDINGS) & (F.col("q") != ""))
    both = rows.join(blocks, ["doc_id", "part", "b"])
    both = both.withColumn("line", F.regexp_replace("text", r"\s+", " ")).withColumn("start", F.expr("instr(line, q) - 1")).where("start >= 0").drop("line")
    return both.dropDuplicates(["doc_id", "part", "b", "t", "start"]).drop("text")
