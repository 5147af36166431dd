"""From placed lines to a document's blocks: notes at the foot, paragraphs, breaks, and the passes in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X

# How small, how low and how far apart notes at the foot are, and how they begin.
NOTE_SIZE, NOTE_SURE, NOTE_FROM, NOTE_GAP = 0.92, 0.88, 0.55, 3.2
NOTE_START = r"^(?:[0-9]{1,3}[.)]?\s|[∗⋆†‡§¶*⋄])"
BRACKETED = r"^\s*\[[0-9]{1,3}\]"
TERMINAL = r"[.!?:;\"”’)]\s*$"
FLOATS, OUTSIDE = ("image", "table", "caption"), ("furniture", "footnote")


def share_width(a: str, b: str) -> Column:
    """How much width the boxes of two sides of a join share."""
    return F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))


def footnote_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, seq): the lines of the notes at the foot of pages.

    ``lines`` have text, size, box, raised (begins with a raised mark) and the page's height;
    ``body`` has each document's body size. Notes are smaller than the body, low on the
    page, and nothing of the body's size stands below them in their column. They are what
    lies close together from the bottom up; a block that other text follows is none,
    type that is hardly smaller needs a mark, and captions and reference lists are none.
    """
    key = ["doc_id", "page"]
    rows = lines.join(body, "doc_id").withColumn("small", F.col("size") < F.col("body") * NOTE_SIZE)
    text = rows.where(F.length(F.trim("text")) > 3).groupBy(*key).agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    low = rows.where(F.col("small") & (F.col("y0") > F.col("height") * NOTE_FROM)).join(text, key).where((F.col("x1") > F.col("left") - 5) & (F.col("x0") < F.col("right") + 5))
    normal = rows.where(~F.col("small") & (F.length("text") > 3)).select(*key, "x0", "x1", "y0")
    same = lambda: (F.col("l.doc_id") == F.col("o.doc_id")) & (F.col("l.page") == F.col("o.page"))
    over = same() & (F.col("o.y0") > F.col("l.y0") + 1) & (share_width("l", "o") > 5)
    zone = low.alias("l").join(normal.alias("o"), over, "left_anti").join(normal.select(*key).distinct(), key, "left_semi")
    heads = rows.where(F.col("text").rlike(X.LINE_CLASSES["reference_heading"])).select(*key, "x0", (F.col("x1") + 200).alias("x1"), "y1")
    under = same() & (F.col("o.y1") <= F.col("l.y0")) & (share_width("l", "o") > 0)
    zone = zone.alias("l").join(heads.alias("o"), under, "left_anti")
    # from the bottom up, as long as the next line is near those before it
    up = W.partitionBy(*key).orderBy(F.col("y1").desc(), F.col("seq").desc())
    reached = F.min("y0").over(up.rowsBetween(W.unboundedPreceding, -1))
    far = F.coalesce(reached - F.col("y1") >= NOTE_GAP * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), F.lit(False))
    kept = zone.withColumn("far", far.cast("int")).withColumn("breaks", F.sum("far").over(up)).where("breaks = 0")
    bottom = kept.groupBy(*key).agg(
        F.max("y1").alias("bottom"),
        F.min("size").alias("least"),
        F.bool_or(F.col("raised") | F.col("text").rlike(NOTE_START)).alias("marked"),
        F.min_by("text", F.struct("y0", "x0", "seq")).alias("first"),
        F.count(F.when(F.col("text").rlike(BRACKETED), 1)).alias("bracketed"),
        F.first("body").alias("body"),
    )
    after = rows.select(*key, "x0", "x1", "y0").alias("o")
    followed = kept.join(bottom.select(*key, "bottom"), key).alias("l").join(after, same() & (F.col("o.y0") > F.col("l.bottom")) & (share_width("l", "o") > 5), "left_semi").select("doc_id", "page").distinct()
    notes = bottom.where(F.col("marked") | (F.col("least") < F.col("body") * NOTE_SURE)).where(~X.is_caption(F.col("first")) & ~F.col("first").rlike(BRACKETED) & (F.col("bracketed") < 2))
    return kept.join(notes.select(*key), key, "left_semi").join(followed, key, "left_anti").select(*key, "seq")


def paragraph_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, para, text, size, bold, x0, y0, x1, y1, page, n_lines) of lines (doc_id, para, seq, page, text, size, bold, box).

    The size is that of most characters, the first of equals; a paragraph is bold if more
    than six tenths of its characters are.
    """
    key = ["doc_id", "para"]
    n = F.length("text")
    by_size = lines.groupBy(*key, "size").agg(F.sum(n).alias("chars"), F.min("seq").alias("first")).groupBy(*key).agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("size"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    rows = lines.groupBy(*key).agg(
        joined.alias("text"),
        (F.sum(F.when(F.col("bold"), n).otherwise(0)) > 0.6 * F.sum(n)).alias("bold"),
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.min_by("page", "seq").alias("page"),
        F.count("*").alias("n_lines"),
    )
    return rows.join(by_size, key).select(*key, "text", "size", "bold", "x0", "y0", "x1", "y1", "page", "n_lines")


def continued(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, seq, kind, text, size) with ``para``: the seq of the block that each goes on from.

    A paragraph that was broken off by a column or page goes on: sentence not ended, type
    alike, the next not beginning with a capital. Pictures, tables and captions may
    lie between, and then it has to begin with a small letter. Notes and furniture don't count.
    """
    order = W.partitionBy("doc_id").orderBy("seq")
    running = ~F.col("kind").isin(*FLOATS, *OUTSIDE)
    before = lambda c: F.last(F.when(running, F.col(c)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    since = F.sum(running.cast("int")).over(order)
    rows = blocks.withColumn("__since", since).withColumn("__kind", before("kind")).withColumn("__text", before("text")).withColumn("__size", before("size"))
    floats = F.sum(F.when(F.col("kind").isin(*FLOATS), 1).otherwise(0)).over(order)
    rows = rows.withColumn("__floats", floats).withColumn("__floats_then", F.last(F.when(running, F.col("__floats")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    heading = lambda c: c.rlike(X.LINE_CLASSES["special_heading"])
    begins = F.when(F.col("__floats") > F.col("__floats_then"), F.col("text").rlike(r"^\p{Ll}")).otherwise(~F.col("text").rlike(r"^\p{Lu}"))
    goes = (
        (F.col("kind") == "paragraph") & (F.col("__kind") == "paragraph") & (F.abs(F.col("size") - F.col("__size")) <= 1) & ~F.col("__text").rlike(TERMINAL)
        & begins & ~heading(F.col("text")) & ~heading(F.col("__text")) & ~F.col("text").rlike(X.LINE_CLASSES["list_item"]) & ~F.col("text").rlike(X.LINE_CLASSES["subsection"])
    )
    rows = rows.withColumn("__goes", running & F.coalesce(goes, F.lit(False)))
    first = F.last(F.when(running & ~F.col("__goes"), F.col("seq")), ignorenulls=True).over(order)
    return rows.withColumn("para", F.when(F.col("__goes"), first).otherwise(F.col("seq"))).select(*blocks.columns, "para")


def merged(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, kind, text, size, n_parts): blocks with those that go on from another put into it.

    A word broken by a hyphen is made whole if ``known`` (word) has it whole.
    """
    rows = continued(blocks)
    order = W.partitionBy("doc_id", "para").orderBy("seq")
    left, right = F.regexp_extract(F.lag("text").over(order), r"(\p{L}+)-$", 1), F.regexp_extract("text", r"^(\p{Ll}+)", 1)
    rows = rows.withColumn("whole", F.when((left != "") & (right != ""), F.lower(F.concat(left, right))))
    if known is not None:
        rows = rows.join(known.select(F.col("word").alias("whole"), F.lit(True).alias("is_word")).distinct(), "whole", "left")
    else:
        rows = rows.withColumn("is_word", F.lit(None).cast("boolean"))
    soft = F.endswith(F.lag("text").over(order), F.lit("­"))
    rows = rows.withColumn("closed", F.coalesce(F.col("is_word") | soft, F.lit(False))).withColumn("cut", F.lead("closed").over(order))
    piece = F.concat(F.when(F.row_number().over(order) == 1, "").when(F.col("closed"), "").otherwise(" "), F.when(F.coalesce("cut", F.lit(False)), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    rows = rows.withColumn("piece", piece)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("doc_id", F.col("para").alias("seq")).agg(F.min_by("kind", "seq").alias("kind"), joined.alias("text"), F.min_by("size", "seq").alias("size"), F.count("*").alias("n_parts"))


def joined_fragments(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, x1, size): spans of one baseline as lines, from left to right.

    ``spans`` have doc_id, page, seq, text, x0, x1, base and size. A line ends where the baseline
    changes by a quarter of the size, or where the room is more than 1.6 sizes; a
    bullet by itself belongs to the text after it however far that is.
    """
    order = W.partitionBy("doc_id", "page").orderBy("row", "x0", "seq")
    rows = spans.withColumn("step", F.coalesce(F.col("base") - F.lag("base").over(W.partitionBy("doc_id", "page").orderBy("base", "x0", "seq")) > 0.25 * F.col("size"), F.lit(True)).cast("int"))
    rows = rows.withColumn("row", F.sum("step").over(W.partitionBy("doc_id", "page").orderBy("base", "x0", "seq")))
    bullet = F.lag("text").over(order).rlike(r"^\s*[•‣◦▪●○■►]\s*$")
    wide = (F.col("x0") - F.lag("x1").over(order) > 1.6 * F.col("size")) & ~bullet
    rows = rows.withColumn("new", F.coalesce((F.lag("row").over(order) != F.col("row")) | wide, F.lit(True)).cast("int")).withColumn("line", F.sum("new").over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "page", "line").agg(texts.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("size").alias("size"))


def gutter_cuts(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, n): the words (of lines, numbered n) after which a line is cut at a column gap.

    The gap is over six times the text's height, with two words or more on both sides and
    five on one, and the line above or below has a gap that overlaps it.
    """
    line = W.partitionBy("doc_id", "page", "line")
    order = line.orderBy("n")
    rows = words.withColumn("gap", F.lead("x0").over(order) - F.col("x1")).withColumn("until", F.lead("x0").over(order)).withColumn("count", F.count("*").over(line)).withColumn("at", F.row_number().over(order))
    wide = rows.where((F.col("gap") > 6 * F.col("height"))).select("doc_id", "page", "line", "n", F.col("x1").alias("a"), F.col("until").alias("z"), "at", F.col("count").alias("words"))
    fits = (F.col("at") >= 2) & (F.col("words") - F.col("at") >= 2) & ((F.col("at") >= 5) | (F.col("words") - F.col("at") >= 5))
    # next to each line: the lines above and below, as an equi-join
    near = wide.select("doc_id", "page", F.explode(F.array(F.col("line") - 1, F.col("line") + 1)).alias("line"), F.col("a").alias("b"), F.col("z").alias("y"))
    return wide.where(fits).join(near, ["doc_id", "page", "line"]).where((F.col("a") < F.col("y")) & (F.col("b") < F.col("z"))).select("doc_id", "page", "line", "n").distinct()


def piece_view(items: DataFrame) -> DataFrame:
    """(doc_id, page, piece, x, y, width, height, size, text): pieces with their box in hundredths of the page.

    ``items`` have a box, size, text (null: a picture), seq and the page's page_width and page_height.
    The size is the upper median of the lines'; a piece without text has none.
    """
    part = lambda c, of: F.round(100 * c / F.first(of), 2)
    sizes = F.array_sort(F.collect_list("size"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))), lambda x: x["text"]), " ")
    return items.groupBy("doc_id", "page", "piece").agg(
        part(F.min("x0"), "page_width").alias("x"), part(F.min("y0"), "page_height").alias("y"),
        part(F.max("x1") - F.min("x0"), "page_width").alias("width"), part(F.max("y1") - F.min("y0"), "page_height").alias("height"),
        F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")).alias("size"),
        F.when(F.count("text") > 0, texts).alias("text"),
    )


def math_profile(text: Column, math_chars: Column) -> Column:
    """struct<math, like, chars, words>: characters in a font for formulas, those that formulas are made of, all, and ordinary words."""
    return F.struct(
        math_chars.alias("math"),
        F.regexp_count(text, F.lit(r"[=+\-−×÷·∑∏∫√≤≥≠≈∞∂∇∈⊂∪∩^_{}|<>/]|\p{IsGreek}|[0-9]")).alias("like"),
        F.regexp_count(text, F.lit(r"\S")).alias("chars"),
        F.regexp_count(text, F.lit(r"(?<![\p{L}])[\p{L}]{4,}(?![\p{L}])")).alias("words"),
    )


def detect(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, kind, text, size, level, page): a document's blocks from its placed lines.

    ``lines`` have doc_id, page, seq, text, box, size, bold, raised and the page's height. The
    passes, each over what the ones before have left: running heads and feet; notes at
    the foot; paragraphs; kinds by first words, type and length; paragraphs broken by columns
    and pages joined; levels of headings by size; the title.
    """
    from . import pages, structure
    from .blocks import kept

    # what a pass leaves is written, so that the next one doesn't begin at the first again
    lines = kept(lines)
    body = kept(structure.body_size(lines, "doc_id"))
    out = kept(structure.furniture(lines).select("doc_id", "page", "seq", F.lit("furniture").alias("off")))
    left = kept(lines.join(out, ["doc_id", "page", "seq"], "left_anti"))
    notes = kept(footnote_lines(left, body).withColumn("off", F.lit("footnote")))
    left = kept(left.join(notes, ["doc_id", "page", "seq"], "left_anti"))
    gaps = structure.line_gap(left)
    para = pages.paragraphs(left.join(gaps, ["doc_id", "page"], "left").fillna(3.0, ["gap"]))
    grouped = left.join(para, ["doc_id", "page", "seq"]).withColumn("para", F.min("seq").over(W.partitionBy("doc_id", "page", "para")))
    found = kept(paragraph_stats(kept(grouped)).join(body, "doc_id"))
    t, big = F.col("text"), F.col("size") > F.col("body") + 0.9
    short = (F.length("text") < 120) & ~t.rlike(r"[.,;]\s*$")
    kind = (
        F.when(X.is_caption(t), "caption")
        .when(t.rlike(X.LINE_CLASSES["special_heading"]) | t.rlike(X.LINE_CLASSES["reference_heading"]), "heading")
        .when(t.rlike(X.LINE_CLASSES["numbered_heading"]) & short & (F.col("bold") | big), "heading")
        .when(t.rlike(X.LINE_CLASSES["list_item"]), "list_item")
        .when(short & (big | F.col("bold")), "heading")
        .otherwise("paragraph")
    )
    blocks = found.select("doc_id", F.col("para").alias("seq"), kind.alias("kind"), "text", "size", "page")
    aside = lines.join(out.unionByName(notes.select("doc_id", "page", "seq", "off")), ["doc_id", "page", "seq"]).select("doc_id", "seq", F.col("off").alias("kind"), "text", "size", "page")
    whole = kept(merged(kept(blocks.unionByName(aside)), known).join(lines.select("doc_id", "seq", "page"), ["doc_id", "seq"]))
    sizes = whole.where("kind = 'heading'").groupBy("doc_id", "size").agg(F.min("seq").alias("first"))
    rank = sizes.withColumn("rank", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("size").desc()))).select("doc_id", "size", "rank", F.lit("heading").alias("kind"))
    ranked = kept(whole.join(rank, ["doc_id", "size", "kind"], "left"))
    title = ranked.where((F.col("rank") == 1) & (F.col("page") == F.lit(0))).groupBy("doc_id").agg(F.min("seq").alias("title"))
    ranked = ranked.join(title, "doc_id", "left")
    is_title = F.coalesce(F.col("seq") == F.col("title"), F.lit(False))
    return ranked.select("doc_id", "seq", F.when(is_title, "title").otherwise(F.col("kind")).alias("kind"), "text", "size", F.coalesce(F.least("rank", F.lit(6)), F.lit(0)).cast("int").alias("level"), "page")
