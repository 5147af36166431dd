"""Places of matches in a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Numbers that are added up together in ``sums_before``.
TOGETHER = 64


def sums_before(numbers: Column) -> Column:
    """For each number of an array, the sum of those before it.

    The sums of parts of TOGETHER numbers are folded, and each place adds what its own
    part has before it, so that the work is far below the square of the array's size.
    """
    plus = lambda a, b: a + b
    part_of = lambda i: F.floor(i / TOGETHER).cast("int")

    def with_parts(parts):
        own = lambda i: F.aggregate(F.slice(numbers, part_of(i) * TOGETHER + 1, i % TOGETHER), F.lit(0), plus)
        return F.transform(numbers, lambda _, i: F.get(parts, part_of(i)) + own(i))

    part = lambda c: F.aggregate(F.slice(numbers, c * TOGETHER + 1, F.lit(TOGETHER)), F.lit(0), plus)
    step = lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + part(c)))
    return let(F.aggregate(F.sequence(F.lit(0), part_of(F.size(numbers))), F.array(F.lit(0)), step), with_parts)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches of a pattern that never matches nothing.

    The pieces between the matches give the offsets: each match begins where the
    lengths of the pieces and matches before it add up.
    """

    def placed(found):
        def with_gaps(gaps):
            lengths = F.zip_with(gaps, found, lambda g, m: g + F.length(m))

            def spans(starts):
                firsts = F.zip_with(starts, gaps, lambda s, g: s + g)
                return F.zip_with(firsts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("text")))

            return let(let(lengths, sums_before), spans)

        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(found))
        return F.when(F.size(found) == 0, F.expr(f"cast(array() as {SPANS})")).otherwise(let(gaps, with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def overlaps(a, b) -> Column:
    """Whether two spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def keep_first(spans: Column) -> Column:
    """The spans without those that overlap one before them in the array."""

    def step(acc, x):
        return F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x)))

    return let(spans, lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), step))
