"""Citations in a text: author and date, numbers in brackets, raised numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import keep_first, let, matches
from .text import tidy

# The parts of a citation.
NAME = r"(?:(?i:van|von|de|der|den|du|da|di|la|le|ten|ter|d')\s+)*[A-ZÀ-Þ][\p{L}\p{N}_'’\-]+"
AUTHORS = rf"{NAME}(?:\s*(?:,\s*(?![0-9])|\s+(?:and|&|en)\s+|,\s*(?:and|&)\s+){NAME})*(?:,?\s+et\s+al\.?)?"
YEAR = r"(?:(?:1[5-9]|20)[0-9]{2}[a-z]?|n\.\s?d\.|in press|forthcoming)"
YEARS = rf"{YEAR}(?:\s*,\s*{YEAR})*"
LOCATOR = r"(?:\s*[,:]\s*(?:pp?\.\s*|p\s|chap\.\s*|ch\.\s*)?[0-9]+(?:\s*[-–]\s*[0-9]+)?)?"
SIGNAL = r"(?:(?:see(?:\s+also)?|e\.\s?g\.|cf\.|i\.\s?e\.|also|for example|for a review,?\s*see|zie(?:\s+ook)?|bijv\.)\s*,?\s*)?"
ITEM = rf"{SIGNAL}{AUTHORS},?\s+{YEARS}{LOCATOR}"
AUTHOR_DATE = rf"\(\s*{ITEM}(?:\s*;\s*{ITEM})*\s*\)"
LOOSE = r"\([^()]{3,200}?(?<![\p{L}\p{N}_])(?:1[5-9]|20)[0-9]{2}[a-z]?(?![\p{L}\p{N}_])[^()]{0,60}\)"
NUMERIC = r"\[[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?(?:\s*[,;]\s*[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?)*\]"
RAISED = r"^[0-9]{1,4}(?:\s*[-–,]\s*[0-9]{1,4})*$"
NOTE_MARK = r"\s*\[(?:Note|Noot|Anm\.|Nota)\s*[0-9]+\]"


def numbers(spec: Column, longest: int = 50) -> Column:
    """The numbers of "3, 5-7"; of a range of ``longest`` or more only both ends."""

    def part(p):
        a = F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
        b = F.regexp_extract(p, r"^[0-9]+\s*[-–]\s*([0-9]+)", 1)
        z = b.cast("int")
        steps = F.when((z - a > 0) & (z - a < longest), F.sequence(a, F.greatest(a, z))).otherwise(F.array(a, z))
        return F.when(p.rlike(r"^[0-9]+\s*[-–]\s*[0-9]+"), steps).when(p.rlike(r"^\s*[0-9]+\s*$"), F.array(F.trim(p).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    return F.flatten(F.transform(F.split(spec, r"\s*[,;]\s*"), part))


def _citation(x, kind: str, items: Column, confidence: Column) -> Column:
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(kind).alias("kind"), items.alias("items"), confidence.cast("double").alias("confidence")
    )


def _items(inner: Column) -> Column:
    return F.transform(F.split(inner, r"\s*;\s*"), lambda i: F.trim(i))


def find(text: Column, n_references: Column, raised: Column | None = None) -> Column:
    """The citations of a text in order, none over another.

    ``n_references`` is the length of the list of references (0: none), ``raised`` the
    spans that are set as superscript.
    """
    inside = lambda x: F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2)
    dated = F.filter(matches(text, AUTHOR_DATE), lambda x: F.forall(_items(inside(x)), lambda i: i.rlike(f"^(?:{ITEM})$")))
    dated = F.transform(dated, lambda x: _citation(x, "author_date", _items(F.trim(inside(x))), F.lit(0.97)))
    loose = F.filter(matches(text, LOOSE), lambda x: inside(x).rlike("[A-Z][a-z]+") & ~inside(x).rlike("[=<>%]"))
    loose = F.transform(loose, lambda x: _citation(x, "author_date", _items(inside(x)), F.lit(0.55)))
    as_text = lambda n: F.transform(n, lambda v: v.cast("string"))

    def numeric(x):
        return let(numbers(inside(x)), lambda n: rated(x, n))

    def rated(x, n):
        sure = F.when(F.array_min(n) < 1, 0.3).when((n_references > 0) & (F.array_max(n) <= n_references), 0.97).when(n_references > 0, 0.4).otherwise(0.7)
        return _citation(x, "numeric", as_text(n), sure)

    found = F.concat(dated, loose, F.transform(matches(text, NUMERIC), numeric))
    if raised is not None:
        marked = F.transform(raised, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("text")))
        marked = F.filter(marked, lambda r: F.trim(r["text"]).rlike(RAISED))

        def high(x):
            return let(numbers(F.trim(x["text"])), lambda n: raised_one(x, n))

        def raised_one(x, n):
            return _citation(x, "superscript", as_text(n), F.when((n_references > 0) & (F.array_max(n) <= n_references), 0.9).otherwise(0.6))

        found = F.concat(found, F.transform(marked, high))
    return F.array_sort(keep_first(found))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with each of some ordered, disjoint spans (start, end, put) replaced by ``put``."""

    def step(acc, x):
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["put"])
        return F.struct(x["end"].cast("int").alias("at"), out.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def spans(text: Column) -> Column:
    """Where note marks and citations (of at least 0.5) are: what isn't read out."""
    notes = F.transform(matches(text, NOTE_MARK), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    cited = F.filter(find(text, F.lit(999)), lambda c: c["confidence"] >= 0.5)
    cited = F.transform(cited, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return F.array_sort(keep_first(F.concat(notes, cited)))


def strip(text: Column) -> Column:
    """The text without citations and note marks, its punctuation mended."""
    bare = replace_spans(text, F.transform(spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put"))))
    return tidy(F.regexp_replace(F.regexp_replace(bare, r"\s+([.,;:!?)])", "$1"), r"\(\s*\)", ""))


def item_key(item: Column) -> Column:
    """An item without the word that introduces it."""
    return F.trim(F.regexp_replace(item, r"(?i)^\s*(?:see(?:\s+also)?|e\.\s?g\.|cf\.|i\.\s?e\.|also|for example|zie(?:\s+ook)?)\s*,?\s*", ""))


def surname(item: Column) -> Column:
    """The last word of an item's first name."""
    name = F.regexp_extract(F.regexp_replace(item, f"^{SIGNAL}", ""), f"({NAME})", 1)
    return F.element_at(F.split(name, r"\s+"), -1)


def year(item: Column) -> Column:
    return F.regexp_extract(item, f"({YEAR})", 1)
