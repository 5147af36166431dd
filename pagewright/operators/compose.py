"""From ordered items to output: runs of style, text, Markdown, chapters of a book.

Items are (doc_id, seq, kind, text, level, marker); tables carry their rows as text in
lines of cells divided by tabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FLAGS = ("bold", "italic", "superscript", "subscript", "math")


def runs(text: Column, styles: Column) -> Column:
    """array<struct<text, flags>>: the text cut where a style begins or ends, equal neighbours joined; a raised run isn't lowered."""
    edges = F.flatten(F.transform(styles, lambda s: F.array(s["start"], s["end"])))
    inside = F.transform(edges, lambda e: F.least(F.greatest(e, F.lit(0)), F.length(text)).cast("int"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inside, F.array(F.length(text).cast("int")))))
    pairs = F.zip_with(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))), F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def flags(p):
        on = {f: F.exists(styles, _covers(p, f)) for f in FLAGS}
        on["subscript"] = on["subscript"] & ~on["superscript"]
        return F.struct(F.substring(text, p["a"] + 1, p["b"] - p["a"]).alias("text"), *(on[f].alias(f) for f in FLAGS))

    def join(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        same = F.size(acc) > 0
        for f in FLAGS:
            same = same & (last[f] == r[f])
        grown = F.struct(F.concat(last["text"], r["text"]).alias("text"), *(r[f].alias(f) for f in FLAGS))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    cut = F.transform(pairs, flags)
    return F.aggregate(cut, F.slice(cut, 1, 0), join)


def _covers(p, flag: str):
    return lambda s: s[flag] & (s["start"] <= p["a"]) & (p["b"] <= s["end"])


def _gathered(items: DataFrame, shown: Column, blank: bool) -> DataFrame:
    rows = items.select("doc_id", "seq", shown.alias("t"))
    if not blank:
        rows = rows.where("t <> ''")
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("x"))
    return whole.select("doc_id", F.concat(F.array_join(F.transform("x", lambda v: v["t"]), "\n\n"), F.lit("\n")).alias("content"))


def text_files(items: DataFrame) -> DataFrame:
    """(doc_id, content): plain text, titles and headings underlined, blocks a blank line apart."""
    t = F.col("text")
    line = F.repeat(F.when(F.col("kind") == "title", "=").otherwise("-"), F.least(F.length(t), F.lit(60)))
    cells = F.array_join(F.transform(F.split(t, "\n"), lambda r: F.replace(r, F.lit("\t"), F.lit(" | "))), "\n")
    shown = (
        F.when(F.col("kind").isin("title", "heading", "box_heading"), F.concat(t, F.lit("\n"), line))
        .when(F.col("kind") == "equation", F.concat(F.lit("    "), t))
        .when(F.col("kind") == "image", "[Image]")
        .when(F.col("kind") == "table", F.when(t == "", "[Table - see PDF export]").otherwise(cells))
        .when(F.col("marker") != "", F.concat_ws(" ", "marker", "text"))
        .otherwise(t)
    )
    return _gathered(items, shown, False)


def markdown_files(items: DataFrame) -> DataFrame:
    """(doc_id, content): Markdown; headings a level down, stars and underscores escaped, tables with bars."""
    t = F.col("text")
    escaped = F.replace(F.replace(t, F.lit("*"), F.lit("\\*")), F.lit("_"), F.lit("\\_"))
    rows = F.transform(F.split(F.replace(t, F.lit("|"), F.lit("\\|")), "\n"), lambda r: F.split(r, "\t"))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    bars = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    ruled = F.array_join(F.concat(F.slice(bars, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))), F.slice(bars, F.lit(2), F.size(bars))), "\n")
    bullet = F.when(F.col("marker").isin("•", "-", "*", "–", ""), F.concat(F.lit("- "), escaped)).otherwise(F.concat(F.lit("- "), F.col("marker"), F.lit(" "), escaped))
    shown = (
        F.when(F.col("kind") == "title", F.concat(F.lit("# "), t))
        .when(F.col("kind").isin("heading", "box_heading"), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce("level", F.lit(1)) + 1)), F.lit(" "), t))
        .when(F.col("kind") == "equation", F.concat(F.lit("> "), escaped, F.lit("  \n> *(equation - see the PDF export)*")))
        .when(F.col("kind") == "image", "*[Image - see PDF export]*")
        .when(F.col("kind") == "table", F.when(t == "", "*[Table - see PDF export]*").otherwise(ruled))
        .when(F.col("kind") == "list_item", bullet)
        .when(F.col("kind").isin("box_paragraph", "quote"), F.concat(F.lit("> "), escaped))
        .when(F.col("kind") == "caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when(F.col("kind") == "about", F.concat(F.lit("---\n\n*"), t, F.lit("*")))
        .when(F.col("marker") != "", F.concat(F.col("marker"), F.lit(" "), escaped))
        .otherwise(escaped)
    )
    return _gathered(items, shown, True)


def chapters(items: DataFrame) -> DataFrame:
    """Items with ``chapter``: a new one at a title or a heading of the first level."""
    top = (F.col("kind") == "title") | ((F.col("kind") == "heading") & (F.col("level") == 1))
    return items.withColumn("chapter", F.sum(F.when(top, 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("seq")))


def about_note(parts: list[tuple[Column, Column]]) -> Column:
    """The sentences (condition, text) that hold, as one note."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, t) for c, t in parts))), " ")


def labels(items: DataFrame, known: DataFrame) -> DataFrame:
    """``items`` (lang, key, n) with ``label`` by ``known`` (lang, key, label), in English where a language has none."""
    own = known.select("lang", "key", F.col("label").alias("own"))
    english = known.where("lang = 'en'").select("key", F.col("label").alias("english"))
    rows = items.join(own, ["lang", "key"], "left").join(english, "key", "left")
    return rows.withColumn("label", F.replace(F.coalesce("own", "english"), F.lit("{n}"), F.coalesce(F.col("n").cast("string"), F.lit("")))).drop("own", "english")
