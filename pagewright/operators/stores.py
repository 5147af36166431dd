"""What is kept between runs: raw documents, answers of models, the log of what was sent; and what a session begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents and log entries that are kept.
RAW_KEPT, LOG_KEPT = 30, 500
ENTRY = "task string, provider string, model string, items int, prompt string, answer string, error string, input_tokens long, output_tokens long, when double"


def raw_key(content: Column, *parts: Column) -> Column:
    """The key of a document that was read: a digest of its content and of all that the reading depends on."""
    return F.sha2(F.concat_ws("\x1f", F.sha2(content, 256), *parts), 256)


def answer_key(*parts: Column) -> Column:
    """The key of an answer; the text itself is never a key."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def newest(rows: DataFrame, kept: int = RAW_KEPT, *order: Column) -> DataFrame:
    """The ``kept`` newest rows, by ``order``: a limit that is the store's own."""
    return rows.orderBy(*order).limit(kept)


def missing(asked: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose key the store doesn't have, one for each key."""
    return asked.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value): the store with new values; a new value of a key takes the place of the old."""
    return store.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def log_entries(lines: DataFrame, kept: int = LOG_KEPT) -> DataFrame:
    """The ``kept`` newest entries of a log of JSON lines (n, value), oldest first; damaged lines are passed over."""
    read = lines.select("n", F.from_json("value", ENTRY, {"mode": "PERMISSIVE"}).alias("e")).where(F.col("e").isNotNull() & F.col("e.task").isNotNull())
    return read.orderBy(F.col("n").desc()).limit(kept).select("n", "e.*").orderBy("n")


def log_text(entries: DataFrame) -> DataFrame:
    """(n, text): each entry as it is shown to the reader."""
    head = F.concat(F.lit("=== "), F.col("provider"), F.lit(" / "), F.col("model"), F.lit("  task: "), F.col("task"), F.lit("  items: "), F.col("items").cast("string"))
    tokens = F.concat(F.lit("tokens in: "), F.col("input_tokens").cast("string"), F.lit("  tokens out: "), F.col("output_tokens").cast("string"))
    answer = F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(F.coalesce("error", F.lit("")))
    return entries.select("n", F.concat_ws("\n", head, tokens, F.lit("--- sent"), F.coalesce("prompt", F.lit("")), F.lit("--- received"), answer).alias("text"))


def session_defaults(blocks: DataFrame, detected: DataFrame, chosen: str | None = None) -> DataFrame:
    """(doc_id, lang, title): the chosen language or the detected one, and the first title block's text, or else the first heading's."""
    rank = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "heading", 1)
    title = blocks.withColumn("__rank", rank).where("__rank is not null").groupBy("doc_id").agg(F.min_by("text", F.struct("__rank", "seq")).alias("title"))
    lang = F.lit(chosen) if chosen else F.col("lang")
    return detected.join(title, "doc_id", "left").select("doc_id", F.coalesce(lang, F.lit("en")).alias("lang"), "title")


def session(spark: SparkSession, path: str, chosen: str | None = None) -> dict[str, DataFrame]:
    """All that a session of a folder begins with: its blocks, locked and unreadable files, and each document's defaults."""
    from ..functions import text as X
    from ..sources.containers import read_files

    rows = read_files(spark, path).withColumnRenamed("path", "doc_id")
    blocks = rows.where(~F.col("kind").isin("locked", "unreadable"))
    said = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    detected = said.select("doc_id", X.language(F.col("text")).alias("lang"))
    refused = rows.where(F.col("kind").isin("locked", "unreadable")).select("doc_id", "kind", "lock")
    return {"blocks": blocks.drop("lock"), "refused": refused, "defaults": session_defaults(blocks, detected, chosen)}


