"""When the words of a spoken text begin, in proportion to their sounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What a pause weighs, in sounds.
SHORT_PAUSE, LONG_PAUSE = 3, 5


def sound_weight(sounds: Column) -> Column:
    """A spoken word's weight: its sounds, without marks of stress and length, and its pauses."""
    return F.regexp_count(sounds, F.lit(r"[^\s,;:.!?ˈˌː]")) + SHORT_PAUSE * F.regexp_count(sounds, F.lit("[,;:]")) + LONG_PAUSE * F.regexp_count(sounds, F.lit("[.!?]"))


def letter_weight(word: Column) -> Column:
    """A written word's weight: its letters, and the pause after it."""
    return F.length(word) + F.when(word.rlike("[,;:]$"), SHORT_PAUSE).when(word.rlike("[.!?]$"), LONG_PAUSE).otherwise(1)


def word_times(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, n, start): when each word (doc_id, n, text) starts, in seconds.

    ``parts`` (doc_id, part, seconds, sounds) were spoken one after the other, their words apart by
    a space. Where the voice said as many words as are written, each has its own
    time; otherwise the whole time is dealt by letters.
    """
    order = W.partitionBy("doc_id").orderBy("part")
    before = F.coalesce(F.sum("seconds").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    said = parts.withColumn("t0", before).select("doc_id", "part", "seconds", "t0", F.posexplode(F.split("sounds", " ")).alias("k", "sounds"))
    said = said.withColumn("weight", sound_weight(F.col("sounds"))).where("weight > 0")
    part = W.partitionBy("doc_id", "part")
    done = F.coalesce(F.sum("weight").over(part.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    said = said.withColumn("start", F.col("t0") + F.col("seconds") * done / F.sum("weight").over(part))
    said = said.select("doc_id", "start", (F.row_number().over(W.partitionBy("doc_id").orderBy("part", "k")) - 1).alias("n"))
    spoken = said.groupBy("doc_id").agg(F.count("*").alias("spoken"))
    whole = parts.groupBy("doc_id").agg(F.sum("seconds").alias("whole"))
    every = W.partitionBy("doc_id")
    weight = letter_weight(F.col("text"))
    passed = F.coalesce(F.sum(weight).over(every.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = words.withColumn("by_letters", passed / F.sum(weight).over(every)).withColumn("written", F.count("*").over(every))
    rows = rows.join(whole, "doc_id", "left").join(spoken, "doc_id", "left").join(said, ["doc_id", "n"], "left")
    alike = F.coalesce(F.col("spoken") == F.col("written"), F.lit(False))
    return rows.select("doc_id", "n", F.when(alike, F.col("start")).otherwise(F.coalesce("whole", F.lit(0.0)) * F.col("by_letters")).alias("start"))
