"""Greedy grouping of ordered pieces, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# What ends with a full stop without ending a sentence.
ABBREVIATIONS = (
    "e.g. i.e. etc. et al. cf. vs. dr. mr. mrs. ms. prof. fig. figs. eq. no. pp. p. vol. ed. eds. st. approx. ca. resp. incl. z.b. bzw. bijv. o.a. d.w.z. p.ex. cf ibid."
).split()


def parts(sizes: Column, limit: int) -> Column:
    """array<int>: the part of each piece; a part holds at most ``limit``, or one piece."""

    def step(acc, n):
        full = (acc["used"] + n > limit) & (F.size(acc["out"]) > 0)
        part = F.when(full, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(F.when(full, n).otherwise(acc["used"] + n).cast("int").alias("used"), part.cast("int").alias("part"), F.concat(acc["out"], F.array(part.cast("int"))).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("part"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def cut_words(text: Column, most: int = 1500) -> Column:
    """The text on one line, cut after ``most`` words with an ellipsis (what a check reads of a block)."""
    w = words(text)
    return F.array_join(F.when(F.size(w) > most, F.concat(F.slice(w, 1, most), F.array(F.lit("…")))).otherwise(w), " ")


def char_parts(sentences: Column, limit: int = 600) -> Column:
    """Sentences joined into texts of at most ``limit`` characters; a longer one stands alone."""

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences, F.expr("cast(array() as array<string>)"), step)


def ends_sentence(word: Column, following: Column) -> Column:
    """Whether a sentence ends after a word, by the next one (null: none)."""
    stop = word.rlike(r"[.!?…][\"'”’)\]]*$")
    short = F.lower(word).isin(*ABBREVIATIONS) | word.rlike(r"^(?:[A-Za-z]\.)+$")
    colon = F.endswith(word, F.lit(":")) & F.coalesce(following.rlike(r"^\p{Lu}"), F.lit(False))
    return F.when(~stop, colon).when(short, False).otherwise(following.isNull() | ~following.rlike(r"^\p{Ll}"))


def ends(found: Column) -> Column:
    """array<boolean> for an array of words."""
    return F.transform(found, lambda w, i: ends_sentence(w, F.get(found, i + 1)))


def spread(lengths: Column) -> Column:
    """array<int>: the number of each run, as often as the run is long."""
    return F.flatten(F.transform(lengths, lambda n, k: F.array_repeat(k, n)))


def units(stops: Column, most: int = 60) -> Column:
    """array<int>: the reading unit of each word; a unit ends where a sentence does or after ``most`` words.

    The fold keeps one number for each unit, not for each word, so that long texts cost little.
    """

    def step(acc, stop):
        grown = acc["used"] + 1
        done = stop | (grown >= most)
        return F.struct(F.when(done, 0).otherwise(grown).alias("used"), F.when(done, F.concat(acc["out"], F.array(grown))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("out"))
    return spread(F.aggregate(stops, start, step, lambda acc: F.when(acc["used"] > 0, F.concat(acc["out"], F.array(acc["used"]))).otherwise(acc["out"])))


def summary_parts(found: Column, size: int = 3000) -> Column:
    """array<int>: the first word of each part; a part ends after a sentence in its last fifth if there is one."""

    def step(acc, _):
        start = F.try_element_at(acc, F.lit(-1))
        end = start + size
        stop = F.try_element_at(F.filter(F.sequence(end, F.floor(start + size * 0.8).cast("int") + 1, F.lit(-1)), lambda k: F.get(found, k - 1).rlike(r"[.!?]$")), F.lit(1))
        return F.when(end >= F.size(found), acc).otherwise(F.concat(acc, F.array(F.coalesce(stop, end).cast("int"))))

    # each part has at least four fifths of its size, which bounds the number of steps
    steps = F.sequence(F.lit(1), F.ceil(F.size(found) / (size * 0.8)).cast("int") + 1)
    return F.aggregate(steps, F.array(F.lit(0)), step)


def lines(widths: Column, limit: int, space: int = 1) -> Column:
    """array<int>: the line of each word, as many to a line as fit."""

    def step(acc, w):
        full = (acc["n"] > 0) & (acc["used"] + space + w > limit)
        used = F.when(full | (acc["n"] == 0), w).otherwise(acc["used"] + space + w).cast("int")
        out = F.when(full, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"])
        return F.struct(used.alias("used"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), out.alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))
    return spread(F.aggregate(widths, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"])))
