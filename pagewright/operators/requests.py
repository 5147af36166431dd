"""Planning and logging of requests to an external model. Nothing here reaches a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X

ITEMS = 30


def plan(items: DataFrame, cache: DataFrame, size: int = ITEMS) -> DataFrame:
    """(key, snippet, ids, request): snippets without a cached answer, each once, ``size`` to a request.

    ``items`` has id and snippet, ``cache`` key. Keys are hashes, so their first two digits
    deal them evenly to 256 parts; numbers run on from part to part, so that all requests
    but the last are full without any sort of everything in one task.
    """
    keyed = items.withColumn("key", X.cache_key(F.col("snippet"))).join(cache.select("key").distinct(), "key", "left_anti")
    once = keyed.groupBy("key").agg(F.first("snippet").alias("snippet"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("part", F.substring("key", 1, 2))
    sizes = once.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("key")) - 1
    return once.join(F.broadcast(before), "part").withColumn("request", F.floor((F.col("before") + place) / size)).select("key", "snippet", "ids", "request")


def verdict(original: Column, replacement: Column, confidence: Column, source: Column, wrong: Column, word: Column) -> Column:
    """struct<replacement, confidence, source> of a fix after a model's answer, which may change a word a little only."""
    same = F.struct(replacement.alias("replacement"), confidence.alias("confidence"), source.alias("source"))
    put = lambda r, c, s: F.struct(r.alias("replacement"), c.alias("confidence"), F.lit(s).alias("source"))
    far = F.levenshtein(F.lower(word), F.lower(original)) > F.greatest(F.lit(2), F.floor(F.length(original) / 3))
    return (
        F.when(~wrong, put(replacement, F.least(confidence, F.lit(0.3)), "dictionary; AI: probably not an error"))
        .when((word == "") | F.contains(word, F.lit(" ")) | far, same)
        .when(word == replacement, put(replacement, F.greatest(confidence, F.lit(0.9)), "dictionary; AI agrees"))
        .otherwise(put(word, F.lit(0.8), "ai"))
    )


def checked_order(answer: Column, count: Column) -> Column:
    """A reading order with every piece once, what it left out at the end; null if a piece is unknown or repeated."""
    every = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    fits = F.forall(answer, lambda i: (i >= 0) & (i < count)) & (F.size(F.array_distinct(answer)) == F.size(answer))
    return F.when(fits, F.concat(answer, F.array_except(every, answer)))


def usage(log: DataFrame) -> DataFrame:
    """Requests, items and tokens by task, with a total."""
    return log.rollup("task").agg(F.count("*").alias("requests"), F.sum("items").alias("items"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def newest(rows: DataFrame, time: str, k: int) -> DataFrame:
    """The ``k`` newest rows: a top-k that keeps ``k`` rows for each task."""
    return rows.orderBy(F.col(time).desc(), *(c for c in rows.columns if c != time)).limit(k)


def block_code(kind: Column, level: Column, source: Column) -> Column:
    """How a check names a block's kind, or null for kinds that aren't checked."""
    base = F.when(kind == "heading", F.concat(F.lit("H"), F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(level, F.lit(1)))).cast("string")))
    for name, code in (("title", "T"), ("paragraph", "P"), ("list_item", "L"), ("quote", "Q"), ("caption", "C"), ("footnote", "N")):
        base = base.when(kind == name, code)
    return F.concat(base, F.when(source == "ocr", " scan").otherwise(""))


# A hyphen that stands before "and" or "or" in several languages.
SUSPENDED = r"(?i)[-‐‑]\s+(?:and|or|nor|en|of|und|oder|bzw|et|ou|y|o|e|ed)(?![\p{L}\p{N}_])"
BREAKS = r"[\s\-‐‑\x{AD}]"


def fix_kind(quote: Column, fix: Column, source: Column) -> Column:
    """"word" for a fix that changes spaces and hyphens only, "scan" for a few letters of a recognised word, else null."""
    n = lambda c: F.size(X.words(c))
    refused = (fix == "") | (fix == quote) | (n(quote) > 4) | (n(fix) > 4) | (quote.rlike(SUSPENDED) & ~fix.rlike(SUSPENDED))
    same = F.regexp_replace(fix, BREAKS, "") == F.regexp_replace(quote, BREAKS, "")
    near = F.levenshtein(F.lower(fix), F.lower(quote)) <= F.greatest(F.lit(2), F.floor(F.length(quote) / 3))
    letters = (source == "ocr") & ~F.contains(quote, F.lit(" ")) & ~F.contains(fix, F.lit(" ")) & near
    return F.when(refused, None).when(same, "word").when(letters, "scan")
