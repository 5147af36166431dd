"""Personal data: base expressions and information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The
values found are the protected entities. How strongly a term reveals one of them is
estimated from the corpus, in occurrences of words: of the n(t) occurrences of term t
among N words, k(t, e) stand within ``reach`` words of entity e, which has p(e) = n(e) / N
of all words about it. With ``prior`` occurrences that behave like any word,

    P(e | t) = (k + prior * p(e)) / (n(t) + prior)
    disclosure(t, e) = log2(P(e | t) / p(e)) / log2(1 / p(e))

The disclosure is the pointwise mutual information as a share of the entity's own
information: 0 for a term that says nothing, 1 for one that says all. Copies prove
nothing: inside the surroundings of e, equal surroundings count once, outside each
occurrence counts. A term discloses an entity if its disclosure is ``threshold`` or
more and P(e | t) is ``odds`` or more. Every entity is judged, however rare: a word seen
once in the corpus, beside an entity seen once, reaches even odds and no more, and a word
that stands as often elsewhere stays below. Terms that disclose get spans of kind
``term`` wherever they occur, and a sanitised text replaces every span by its kind.

Scale: each pass over the documents is a map. What is shuffled is a row for each entity
of a document with the words about it, and word counts combined within a task. A
term that stands nowhere but about its entity is marked from these rows, by joins; only
terms that occur elsewhere too have to be looked for in all texts, in blocks of at most
``block`` terms, each a job of its own, so that the driver and the tasks hold one block.

Defined cases: a null or empty text has no spans and stays as it is; repeated rows
each give a row; a null id is kept; an empty table gives an empty result; other
columns are not read. Long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from ._shared import map_rows, materialise, met, named, slices

KINDS = ("email", "ip", "card", "phone", "term")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Starts at the first digit of a run only: a later one can't do better.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of the base kinds, each kind leftmost and without overlaps."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((0, s, at := m.end()))
        p = text.find("@", p + 1)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def entity(text: str, span: tuple[int, int, int]) -> str:
    kind, s, e = span
    value = text[s:e]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGITS.sub('', value)}"


def words(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8."""
    return text.encode().translate(_TO_WORDS).split()


def surroundings(text: str | None, reach: int, found: list[tuple[int, int, int]] | None = None) -> dict[str, list[tuple[str, int, int]]]:
    """For each entity of a text, the words within ``reach`` words of it, outside all base spans: (term, start, end) in order."""
    found = base_spans(text) if found is None else found
    if not found:
        return {}
    taken = sorted((s, e) for _, s, e in found)
    starts, terms, k, until = [], [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            until = max(until, taken[k][1])
            k += 1
        if m.start() >= until:
            starts.append(m.start())
            terms.append((m[0].encode().lower().decode(), m.start(), m.end()))
    near: dict[str, set[int]] = {}
    for span in found:
        i = bisect_left(starts, span[1])
        near.setdefault(entity(text, span), set()).update(range(max(0, i - reach), min(i + reach, len(terms))))
    return {e: [terms[i] for i in sorted(at)] for e, at in near.items()}


def word_counts(docs: DataFrame, text_col: str, counted: int = 300_000) -> DataFrame:
    """(term, n) over all texts; a task hands on what it has counted at ``counted`` words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                if text:
                    held.update(words(text))
                if len(held) >= counted:
                    yield flush()
                    held.clear()
        yield flush()

    return docs.select(named(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def entities(docs: DataFrame, text_col: str, reach: int) -> DataFrame:
    """(key, entity, place, terms array<struct<term, s, e>>), a row for each entity of a text; a written table.

    ``key`` is the text's MD5, ``place`` stands for the words about the entity.
    """

    def near():
        def each(key, text):
            out = []
            for e, found in surroundings(text, reach).items():
                place = xxhash.xxh64_intdigest("\x1f".join(t for t, _, _ in found)) >> 1
                out.append((key, e, place, [{"term": t, "s": s, "e": z} for t, s, z in found]))
            return out

        return each

    texts = docs.select(F.md5(named(text_col)).alias("key"), named(text_col).alias("text")).where("text is not null")
    return materialise(map_rows(texts, "key string, entity string, place long, terms array<struct<term string, s int, e int>>", near), "near", texts=True)


def disclosing_terms(docs: DataFrame, text_col: str = "text", reach: int = 8, threshold: float = 0.8, odds: float = 0.5, prior: float = 1.0, near: DataFrame | None = None) -> DataFrame:
    """(term, entity, places, joint, n, disclosure): the terms that disclose an entity, as a written table.

    ``joint`` counts a term's occurrences about the entity, ``places`` those in different
    surroundings, ``n`` all in the corpus.
    """
    near = entities(docs, text_col, reach) if near is None else near
    counts = materialise(word_counts(docs, text_col), "words", texts=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # equal surroundings of an entity are one place
    placed = near.groupBy("entity", "place").agg(F.first(F.transform("terms", lambda x: x["term"])).alias("terms"), F.count("*").alias("copies"))
    pairs = placed.select("entity", "copies", F.explode("terms").alias("term"))
    together = materialise(pairs.groupBy("entity", "term").agg(F.count("*").alias("places"), F.sum("copies").alias("joint")), "pairs")
    about = materialise(together.groupBy("entity").agg(F.sum("places").alias("about"), F.count("*").alias("pairs")), "about")
    often = together.groupBy("term").agg(F.count("*").alias("pairs"))
    known = materialise(counts.join(often, "term"), "known")
    both = met(met(together, about, "entity", "pairs"), known, "term", "pairs")
    share = F.col("about") / F.lit(float(max(total, 1)))
    seen = F.col("places") + F.col("n") - F.col("joint")  # each place once, and all occurrences elsewhere
    chance = (F.col("places") + F.lit(prior) * share) / (seen + F.lit(prior))
    disclosure = F.when(share < 1, F.log2(chance / share) / F.log2(1 / share)).otherwise(0.0)
    found = both.withColumn("chance", chance).withColumn("disclosure", disclosure).where((F.col("disclosure") >= threshold) & (F.col("chance") >= odds))
    return materialise(found.select("term", "entity", "places", "joint", "n", "disclosure"), "terms")


def term_spans(text: str, terms: frozenset[bytes], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the terms outside base spans."""
    if terms.isdisjoint(words(text)):
        return []
    held, out, k, until = sorted((s, e) for _, s, e in taken), [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(held) and held[k][0] < m.end():
            until = max(until, held[k][1])
            k += 1
        if m.start() >= until and m[0].encode().lower() in terms:
            out.append((BASE, *m.span()))
    return out


_SPANS = "array<struct<k int, s int, e int>>"
_packed = lambda found: [{"k": k, "s": s, "e": e} for k, s, e in found]


def _confined(near: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, more): by text, the spans of terms that occur about their entity only; a written table."""
    alone = terms.where("n = joint").select("entity", "term")
    spots = near.select("key", "entity", F.explode("terms").alias("x")).select("key", "entity", "x.term", "x.s", "x.e")
    # the pairs are rare: a hot entity has few terms that stand nowhere else
    spans_ = spots.join(alone, ["entity", "term"]).select("key", F.struct(F.lit(BASE).alias("k"), "s", "e").alias("span"))
    return materialise(spans_.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("more")), "confined")


def _scanned(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, block: int, with_text: bool) -> DataFrame:
    """(id, key, text, found array of kind, start, end) by the base kinds and the terms that occur anywhere; without ``with_text`` text is null.

    ``key`` is the text's MD5, or null where no base span was found.
    """
    ddl = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(f"key string, text string, found {_SPANS}")])
    rows = docs.select(named(id_col).alias("id"), F.md5(named(text_col)).alias("key"), named(text_col).alias("text"))
    anywhere = terms.where("n > joint").select("term").distinct()
    n = max(1, -(-anywhere.count() // block))
    for number in range(n):
        held = frozenset(r[0].encode() for r in anywhere.where(F.pmod(F.xxhash64("term"), F.lit(n)) == number).collect())
        sent = docs.sparkSession.sparkContext.broadcast(held)
        keep = with_text or number + 1 < n

        def first(sent=sent, keep=keep):
            def each(i, key, text):
                base = base_spans(text)
                more = term_spans(text, sent.value, base) if text and sent.value else []
                return [(i, key if base else None, text if keep else None, _packed(base + more))]

            return each

        def more(sent=sent, keep=keep):
            def each(i, key, text, found):
                base = [(x["k"], x["s"], x["e"]) for x in found if x["k"] < BASE]
                return [(i, key, text if keep else None, found + _packed(term_spans(text, sent.value, base) if text else []))]

            return each

        rows = map_rows(rows, ddl, more if number else first, 512)
        if number + 1 < n:
            rows = materialise(rows, "scanned")
            sent.unpersist()
    return rows


def spans_of(docs: DataFrame, id_col: str, text_col: str, block: int, reach: int = 8, with_text: bool = False, sent: int = 1 << 18, **how) -> DataFrame:
    """(id, text, found): the spans of each row, those of kind ``term`` included."""
    near = entities(docs, text_col, reach)
    terms = disclosing_terms(docs, text_col, reach, near=near, **how)
    more = _confined(near, terms)
    rows = _scanned(docs, id_col, text_col, terms, block, with_text)
    if more.count() <= sent:
        rows = rows.join(F.broadcast(more), "key", "left")
    else:  # only rows with personal data have a key; those without stay where they are
        rows = materialise(rows, "spans")
        by_key = materialise(more.join(rows.groupBy("key").agg(F.count("*").alias("rows")), "key"), "by-key")
        kept = rows.join(more.select("key"), "key", "left_semi")
        rest = rows.where("key is null").unionByName(rows.where("key is not null").join(more.select("key"), "key", "left_anti"))
        rows = met(kept, by_key, "key", "rows").unionByName(rest, allowMissingColumns=True)
    return rows.select("id", "text", F.when(F.col("more").isNotNull(), F.array_union("found", "more")).otherwise(F.col("found")).alias("found"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 500_000, **how) -> DataFrame:
    """(id, spans, text): the spans found and the text with each replaced by its kind's mark."""
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("spans array<struct<kind string, start int, end int>>, text string")])

    def make():
        def each(i, text, found):
            held = sorted(((x["k"], x["s"], x["e"]) for x in found), key=lambda x: (x[1], x[0]))
            return [(i, [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in held], spans.replaced(text, held, MARKS) if held else text)]

        return each

    return map_rows(spans_of(docs, id_col, text_col, block, with_text=True, **how), out, make, 512)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 500_000, **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def each(i, found):
            held = [(x["k"], x["s"], x["e"]) for x in found]
            base = [x for x in held if x[0] < BASE]
            n = [sum(x[0] == k for x in base) for k in range(BASE)]
            return [(i, *n, spans.digest(spans.joined(base, KINDS)), spans.joined(held, KINDS))]

        return each

    rows = spans_of(docs, id_col, text_col, block, **how).select("id", "found")
    return map_rows(rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)
