"""Boxes, pages and recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def area(box: Box) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def overlap_ratio(inner: Box, outer: Box) -> Column:
    """The share of ``inner`` that ``outer`` covers."""
    both = (F.greatest(inner[0], outer[0]), F.greatest(inner[1], outer[1]), F.least(inner[2], outer[2]), F.least(inner[3], outer[3]))
    return F.when(area(inner) > 0, area(both) / area(inner)).otherwise(0.0)


def rotate(x: Column, y: Column, turn: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page shown turned by 0, 90, 180 or 270 degrees, on the page as it was made (width x height)."""
    return (
        F.when(turn == 90, y).when(turn == 180, width - x).when(turn == 270, width - y).otherwise(x),
        F.when(turn == 90, height - x).when(turn == 180, height - y).when(turn == 270, x).otherwise(y),
    )


def page_kind(chars: Column, coverage: Column, hidden: Column) -> Column:
    """"text", "scanned" or "mixed", by visible characters and the share that pictures cover."""
    scanned = ((coverage > 0.7) & ((chars < 25) | hidden)) | ((chars < 25) & (coverage > 0.3))
    return F.when(scanned, "scanned").when((chars >= 25) & (coverage > 0.5) & (chars < 200), "mixed").otherwise("text")


def image_coverage(boxes: DataFrame, page: str, width: float, height: float, grid: int = 40) -> DataFrame:
    """(page, coverage): the share of a grid's cells that a picture touches, each counted once."""
    low = lambda c, size: F.greatest(F.lit(0), F.floor(F.greatest(F.col(c), F.lit(0.0)) / size * grid)).cast("int")
    high = lambda c, size: F.least(F.lit(grid), F.ceil(F.least(F.col(c), F.lit(size)) / size * grid)).cast("int") - 1
    rows = boxes.withColumn("a", low("x0", width)).withColumn("b", high("x1", width)).withColumn("c", low("y0", height)).withColumn("d", high("y1", height)).where("a <= b and c <= d")
    cells = rows.select(page, F.explode(F.sequence("a", "b")).alias("gx"), "c", "d").select(page, "gx", F.explode(F.sequence("c", "d")).alias("gy")).distinct()
    return cells.groupBy(page).agg((F.count("*") / (grid * grid)).alias("coverage"))


def hidden_layer(spans: DataFrame, page: str) -> DataFrame:
    """(page, hidden): whether over 80 % of the characters (type, n) are drawn invisibly (type 3)."""
    return spans.groupBy(page).agg((F.sum(F.when(F.col("type") == 3, F.col("n")).otherwise(0)) > F.sum("n") * 0.8).alias("hidden"))


def repeated_pictures(placed: DataFrame) -> DataFrame:
    """(doc_id, xref) of pictures on at least three pages and half of them, in documents of three pages or more."""
    once = placed.select("doc_id", "xref", "page").distinct()
    pages = once.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))
    return once.groupBy("doc_id", "xref").agg(F.count("*").alias("n")).join(pages, "doc_id").where("pages >= 3 and n >= 3 and n >= 0.5 * pages").select("doc_id", "xref")


def best_reading(words: DataFrame) -> DataFrame:
    """(page, reading, poor): the reading whose words run across, then of the highest mean confidence; poor under 15 words or 55."""
    read = words.groupBy("page", "reading").agg(F.bool_and("across").alias("across"), F.coalesce(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), F.lit(0.0)).alias("mean"), F.count("*").alias("n"))
    best = F.max_by(F.struct("reading", ((F.col("n") < 15) | (F.col("mean") < 55)).alias("poor")), F.struct("across", "mean", -F.col("reading")))
    return read.groupBy("page").agg(best.alias("b")).select("page", "b.reading", "b.poor")


def is_noise(text: Column, mean: Column) -> Column:
    """Lines without letters and digits, or with a few of low confidence (null: unknown)."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    sure = F.coalesce(mean, F.lit(100))
    return (n == 0) | ((n <= 3) & (sure < 40)) | ((sure < 25) & (n < 12))


def type_size(text: Column, height: Column) -> Column:
    """The type size of a recognised line, by its height and the shapes of its letters."""
    em = F.when(text.rlike(r"[A-Zbdfhijklt0-9(\[{|/]"), 0.72).otherwise(0.5) + F.when(text.rlike(r"[gjpqy,;(\[{|]"), 0.22).otherwise(0.0)
    return F.bround(height / em * 2, 0) / 2
