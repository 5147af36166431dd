"""Corrections as an overlay over text that never changes.

A correction is struct<start, end, original, replacement, status, source>; arrays hold
them in the order in which they were made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, overlaps

BY_HAND = ("user", "check")


def applied(c) -> Column:
    return c["status"].isin("auto", "accepted")


def effective(corrections: Column) -> Column:
    """The applied corrections, without those that overlap one made by hand."""

    def kept(live):
        hand = F.filter(live, lambda c: c["source"].isin(*BY_HAND))
        return F.filter(live, lambda c: c["source"].isin(*BY_HAND) | ~F.exists(hand, lambda u: overlaps(c, u)))

    return let(F.filter(corrections, applied), kept)


def _numbered(corrections: Column, sign: int) -> Column:
    """In order of sign * start, and as given among equals."""
    keyed = F.transform(corrections, lambda c, i: F.struct((c["start"] * sign).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def apply(text: Column, corrections: Column) -> Column:
    """The text with its effective corrections, from the right, where the original still stands."""

    def step(out, c):
        stands = F.substring(out, c["start"] + 1, c["end"] - c["start"]) == c["original"]
        put = F.concat(F.substring(out, F.lit(1), c["start"]), c["replacement"], F.substring(out, c["end"] + 1, F.length(out)))
        return F.when(stands, put).otherwise(out)

    return F.aggregate(_numbered(effective(corrections), -1), text, step)


def shift(position: Column, text: Column, corrections: Column) -> Column:
    """Where a position of the original text is once the corrections are in."""
    standing = F.filter(effective(corrections), lambda c: F.substring(text, c["start"] + 1, c["end"] - c["start"]) == c["original"])

    def step(acc, c):
        grown = F.struct((acc["delta"] + F.length(c["replacement"]) - (c["end"] - c["start"])).cast("int").alias("delta"), acc["at"].alias("at"))
        inside = (c["start"] + acc["delta"] + F.least(position - c["start"], F.length(c["replacement"]))).cast("int")
        found = F.struct(acc["delta"].alias("delta"), inside.alias("at"))
        return F.when(acc["at"].isNotNull(), acc).when(c["end"] <= position, grown).when(c["start"] < position, found).otherwise(acc)

    start = F.struct(F.lit(0).alias("delta"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(_numbered(standing, 1), start, step, lambda acc: F.coalesce(acc["at"], (position + acc["delta"]).cast("int")))


def map_spans(spans: Column, text: Column, corrections: Column) -> Column:
    """Spans (start, end, ...) moved along; those that vanish go."""
    moved = F.transform(spans, lambda s: s.withField("start", shift(s["start"], text, corrections)).withField("end", shift(s["end"], text, corrections)))
    return F.filter(moved, lambda s: s["end"] > s["start"])


def clip_spans(spans: Column, start: Column, end: Column) -> Column:
    """Spans inside [start, end), counted from there."""
    cut = F.transform(spans, lambda s: s.withField("start", F.greatest(s["start"], start) - start).withField("end", F.least(s["end"], end) - start))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def minimal_edit(old: Column, new: Column) -> Column:
    """struct<start, end, original, replacement>: what changed, widened to whole words; null if nothing did."""
    n = F.least(F.length(old), F.length(new))
    at = lambda t, i: F.substring(t, i, F.lit(1))
    # the first place that differs
    head = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: at(old, i) != at(new, i)), F.lit(1)) - 1, n)
    rest = n - head
    tail = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(rest, F.lit(1))), lambda i: at(old, F.length(old) - i + 1) != at(new, F.length(new) - i + 1)), F.lit(1)) - 1, rest)
    tail = F.greatest(F.least(tail, rest), F.lit(0))
    kept_head = F.length(F.regexp_extract(F.substring(old, F.lit(1), head), r"^((?s:.*)\s)?", 1))
    kept_tail = F.length(F.regexp_extract(F.substring(old, F.length(old) - tail + 1, tail), r"^\S*(\s(?s:.*))?$", 1))
    edit = F.struct(
        kept_head.alias("start"),
        (F.length(old) - kept_tail).alias("end"),
        F.substring(old, kept_head + 1, F.length(old) - kept_tail - kept_head).alias("original"),
        F.substring(new, kept_head + 1, F.length(new) - kept_tail - kept_head).alias("replacement"),
    )
    return F.when((new != old) & (new != ""), edit)


def replace_run(text: Column, styles: Column, start: Column, end: Column, put: Column) -> Column:
    """struct<text, styles>: the text with one run replaced, and its style ranges moved along; those that end up empty go."""
    delta = F.length(put) - (end - start)
    moved = lambda i: F.when(i <= start, i).when(i < end, start + F.length(put)).otherwise(i + delta)
    kept = F.filter(F.transform(styles, lambda s: s.withField("start", moved(s["start"])).withField("end", moved(s["end"]))), lambda s: s["end"] > s["start"])
    return F.struct(F.concat(F.substring(text, F.lit(1), start), put, F.substring(text, end + 1, F.length(text))).alias("text"), kept.alias("styles"))


def raised_ranges(styles: Column, length: Column) -> Column:
    """The raised ranges of a text (array<struct<start, end>>) that lie in it and in no formula."""
    formulas = F.filter(styles, lambda s: s["math"])
    inside = lambda s: F.exists(formulas, lambda m: (m["start"] <= s["start"]) & (s["end"] <= m["end"]))
    found = F.filter(styles, lambda s: s["superscript"] & ~s["math"] & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= length) & ~inside(s))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
