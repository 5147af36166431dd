"""Whole documents: structure fixes, and the plan of an export.

Blocks are (doc_id, block_id, seq, kind, text, level, page, font_size, footnote_label,
fixes, styles); fixes are corrections as functions.overlay has them, styles are
array<struct<start, end, bold, italic, superscript, subscript, math>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import citations as C
from ..functions import overlay as O
from ..functions import text as X
from ..functions.spans import keep_first
from ..settings import Format
from . import links as L
from . import structure as S

PLAIN = ("title", "heading", "reference")


def view(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """Blocks with applied structure fixes (doc_id, block_id, fix, end, level): a heading split off, demoted, or a block hidden.

    Of several for a block the first by kind holds. The part after a heading that was split
    off keeps the block's id, the heading gets it with "~h".
    """
    one = findings.groupBy("doc_id", "block_id").agg(F.min(F.struct("fix", "end", F.col("level").alias("to"))).alias("f"))
    rows = blocks.join(one, ["doc_id", "block_id"], "left")
    split = (F.col("f.fix") == "heading") & (F.col("f.end") > 0) & (F.col("f.end") < F.length("text"))
    same = lambda kind, level, text, mark: F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"), F.concat(F.col("block_id"), F.lit(mark)).alias("block_id"))
    rest = F.expr("substring(text, f.end + 1)")
    head = same(F.lit("heading"), F.col("f.to"), F.rtrim(F.expr("substring(text, 1, f.end)")), "~h")
    tail = same(F.when(F.col("kind") == "list_item", "paragraph").otherwise(F.col("kind")), F.col("level"), F.ltrim(rest), "")
    kind = F.when(F.col("f.fix") == "not_heading", "paragraph").when(F.col("f.fix") == "furniture", "furniture").otherwise(F.col("kind"))
    level = F.when(F.col("f.fix") == "not_heading", 0).otherwise(F.col("level"))
    parts = F.when(F.coalesce(split, F.lit(False)), F.array(head, tail)).otherwise(F.array(same(kind, level, F.col("text"), "")))
    rows = rows.select("*", F.posexplode(parts).alias("part", "p"))
    keep = [c for c in blocks.columns if c not in ("kind", "level", "text", "block_id")]
    return rows.select(*keep, "part", "p.kind", "p.level", "p.text", "p.block_id")


def _cited(rows: DataFrame, references: DataFrame, sure: float) -> tuple[DataFrame, DataFrame]:
    """Replacements (doc_id, block_id, start, end, put) for citations, and the items (doc_id, item, number) they name."""
    n = references.groupBy("doc_id").agg(F.count("*").alias("n_refs"))
    body = rows.where(~F.col("kind").isin(*PLAIN)).join(n, "doc_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)).cast("int"))
    found = body.select("doc_id", "block_id", "seq", F.explode(C.find(F.col("text"), F.col("n_refs"))).alias("c")).where((F.col("c.kind") == "author_date") & (F.col("c.confidence") >= sure))
    items = found.select("doc_id", "block_id", "seq", "c.start", "c.end", F.posexplode("c.items").alias("k", "raw")).withColumn("item", C.item_key(F.col("raw")))
    matched = L.match_references(items.select("doc_id", "item").distinct(), references)
    placed = items.join(matched, ["doc_id", "item"], "left")
    known = placed.select("doc_id", "item", F.struct("seq", "start", "k").alias("seq"), F.when(F.col("reference") >= 0, F.col("reference") + 1).alias("reference"))
    first = known.groupBy("doc_id", "item").agg(F.min("seq").alias("first"), F.min("reference").alias("reference")).join(n, "doc_id", "left")
    extra = F.row_number().over(W.partitionBy("doc_id", F.col("reference").isNull()).orderBy("first"))
    numbers = first.select("doc_id", "item", "reference", F.coalesce("reference", F.coalesce("n_refs", F.lit(0)) + extra).cast("long").alias("number"))
    marked = placed.drop("reference").join(numbers.drop("reference"), ["doc_id", "item"])
    marks = marked.groupBy("doc_id", "block_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("k", "number"))).alias("x"))
    put = F.array_join(F.transform("x", lambda v: F.concat(F.lit("["), v["number"].cast("string"), F.lit("]"))), "")
    return marks.select("doc_id", "block_id", "start", "end", put.alias("put")), numbers


def _noted(rows: DataFrame, notes: DataFrame, word: str) -> tuple[DataFrame, DataFrame]:
    """Replacements for raised note labels, and notes with their numbers: by first marker, then in order."""
    raised = F.filter("styles", lambda s: s["superscript"] & ~s["math"])
    marks = rows.where(~F.col("kind").isin("footnote", "reference")).select("doc_id", "block_id", "seq", "page", "text", F.explode(raised).alias("s"))
    marks = marks.select(F.col("doc_id").alias("doc"), "block_id", "seq", "page", "s.start", "s.end", F.trim(F.expr("substring(text, s.start + 1, s.end - s.start)")).alias("label"))
    listed = notes.select(F.col("doc_id").alias("doc"), "page", F.col("footnote_label").alias("label"), F.struct(F.col("seq").alias("s"), F.col("block_id").alias("id")).alias("note")).where("label is not null")
    found = L.notes_of_markers(marks, listed).where("note is not null")
    first = found.groupBy("doc", "note.id").agg(F.min(F.struct("seq", "start")).alias("first"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("first").isNull(), "first", "seq"))
    ranked = notes.join(first.select(F.col("doc").alias("doc_id"), F.col("id").alias("block_id"), "first"), ["doc_id", "block_id"], "left")
    counted = ranked.where("first is not null or footnote_label is not null").withColumn("number", number)
    plain = ranked.where("first is null and footnote_label is null").withColumn("number", F.lit(None).cast("int"))
    numbered = counted.unionByName(plain)
    marked = found.select(F.col("doc").alias("doc_id"), F.col("block_id"), "start", "end", F.col("note.id").alias("note_id"))
    numbers = numbered.select("doc_id", F.col("block_id").alias("note_id"), "number")
    put = F.concat(F.lit(f" [{word} "), F.col("number").cast("string"), F.lit("]"))
    return marked.join(numbers, ["doc_id", "note_id"]).select("doc_id", "block_id", "start", "end", put.alias("put")), numbered


def compose(blocks: DataFrame, settings: Format, note_word: str = "Note", notes_heading: str = "Notes", unmatched_heading: str = "Citations not matched to the reference list", sure: float = 0.9) -> DataFrame:
    """Items (doc_id, seq, kind, text, level, marker, keep): the plan of an export, in order.

    Corrections are put in; furniture goes, citations become numbers and footnotes move to
    the end, as the settings say; then boxes and small print are found.
    """
    columns = ["doc_id", "block_id", "seq", "kind", "level", "page", "font_size", "footnote_label"]
    shown = O.apply(F.col("text"), F.col("fixes"))
    rows = blocks.select(*columns, shown.alias("text"), O.map_spans(F.col("styles"), F.col("text"), F.col("fixes")).alias("styles"))
    if settings.remove_headers_footers:
        rows = rows.where("kind <> 'furniture'")
    ranked = rows.where("kind = 'reference'").withColumn("idx", (F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1).cast("long"))
    references = ranked.select("doc_id", "idx", "text")
    puts, tail = None, []
    if settings.move_footnotes:
        puts, notes = _noted(rows, rows.where("kind = 'footnote'"), note_word)
        rows = rows.where("kind <> 'footnote'")
        label = F.regexp_extract("text", r"^\s*(?:[0-9]{1,3}|[*†‡§¶]+|[a-z])(?=\s|[.)\]]\s|[A-Z])[\s.)]*", 0)
        bare = F.when(F.col("footnote_label").isNotNull(), F.expr("substring(text, length(__l) + 1)")).otherwise(F.col("text"))
        mark = F.when(F.col("number").isNotNull(), F.concat(F.lit(f"[{note_word} "), F.col("number").cast("string"), F.lit("]"))).otherwise("–")
        tail.append((1, notes_heading, 1, notes.withColumn("__l", label).select("doc_id", F.coalesce("number", F.lit(1 << 30)).alias("n"), bare.alias("text"), mark.alias("marker"))))
    if settings.move_citations:
        cited, numbers = _cited(rows, references, sure)
        puts = cited if puts is None else puts.unionByName(cited)
        mark = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))
        tail.append((2, unmatched_heading, 2, numbers.where("reference is null").select("doc_id", F.col("number").alias("n"), F.concat("item", F.lit(".")).alias("text"), mark.alias("marker"))))
    if puts is not None:
        gathered = puts.groupBy("doc_id", "block_id").agg(keep_first(F.array_sort(F.collect_list(F.struct("start", "end", "put")))).alias("puts"))
        rows = rows.join(gathered, ["doc_id", "block_id"], "left")
        rows = rows.withColumn("text", F.when(F.col("puts").isNotNull(), C.replace_spans(F.col("text"), F.col("puts"))).otherwise(F.col("text")))
    paragraph = rows.where("kind = 'paragraph'").withColumn("size", F.col("font_size"))
    body = S.body_size(paragraph, "doc_id")
    rows = rows.join(body, "doc_id", "left").withColumn("before", F.lag("kind").over(W.partitionBy("doc_id").orderBy("seq")))
    small = (F.col("kind") == "paragraph") & (F.col("font_size") < F.col("body") * 0.85)
    kind = F.when(F.col("kind") == "furniture", "small").when(small & F.col("before").isin("table", "image", "caption"), "caption").when(small, "small").otherwise(F.col("kind"))
    item = X.list_marker(F.col("text"))
    listed = F.col("kind") == "list_item"
    rows = rows.select("doc_id", "seq", kind.alias("kind"), F.when(listed, item["rest"]).otherwise(F.col("text")).alias("text"), "level", F.when(listed, item["marker"]).otherwise("").alias("marker"))
    rows = S.box_sections(rows).withColumn("part", F.lit(0)).withColumn("seq", F.col("seq").cast("long"))
    for part, heading, level, found in tail:
        head = found.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("heading").alias("kind"), F.lit(heading).alias("text"), F.lit(level).alias("level"), F.lit("").alias("marker"), F.lit(True).alias("keep"))
        ends = found.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("n", "text")).cast("long").alias("seq"), F.lit("endnote").alias("kind"), "text", F.lit(0).alias("level"), "marker", F.lit(False).alias("keep"))
        rows = rows.unionByName(head.unionByName(ends).withColumn("part", F.lit(part)))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "seq")) - 1
    return rows.withColumn("seq", place).drop("part")


def picture_width(share: Column) -> Column:
    """A reader's width for a picture, between 0.2 and 1; 0 takes it back (null)."""
    return F.when(share != 0, F.bround(F.greatest(F.lit(0.2), F.least(F.lit(1.0), share)), 3))


def apply_finding(corrections: DataFrame, findings: DataFrame) -> DataFrame:
    """Corrections with those of chosen findings (doc_id, id, start, end, original, replacement), unless one by hand is there."""
    hand = corrections.where("source in ('user', 'check') and status in ('auto', 'accepted')")
    new = L.without_overlap(findings, hand, ["doc_id"])
    made = new.select("doc_id", F.concat(F.lit("check-"), "id").alias("correction_id"), "start", "end", "original", "replacement", F.lit("accepted").alias("status"), F.lit("check").alias("source"))
    return corrections.select(made.columns).unionByName(made)


def undo_finding(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    """Corrections without those of findings (doc_id, id) that were taken back."""
    gone = ids.select("doc_id", F.concat(F.lit("check-"), "id").alias("correction_id"))
    return corrections.join(gone, ["doc_id", "correction_id"], "left_anti")


def stored_highlights(rows: DataFrame) -> DataFrame:
    """Highlights from JSON (doc_id, json); entries that can't be read are passed over."""
    kind = "array<struct<start: int, end: int, colour: string, words: string, note: string>>"
    each = rows.select("doc_id", F.explode(F.from_json("json", kind, {"mode": "PERMISSIVE"})).alias("h"))
    return each.where("h.start is not null and h.end is not null and h.colour is not null").select("doc_id", "h.start", "h.end", "h.colour", F.coalesce("h.words", F.lit("")).alias("words"), F.coalesce("h.note", F.lit("")).alias("note"))
