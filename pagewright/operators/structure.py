"""Structure of documents from positioned lines and ordered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X


def body_size(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, body): the half-point size of most characters, the first seen of equals."""
    sized = lines.groupBy(*keys, (F.bround(F.col("size") * 2, 0) / 2).alias("body")).agg(F.sum(F.length("text")).alias("n"), F.min("seq").alias("first"))
    return sized.groupBy(*keys).agg(F.max_by("body", F.struct("n", -F.col("first"))).alias("body"))


def furniture(lines: DataFrame) -> DataFrame:
    """Running heads, feet and page numbers among ``lines`` (doc_id, page, seq, text, y0, y1, height).

    A line of the outer margins goes if it is a page number, repeats on enough pages, is a
    running head seen twice, is letter-spaced, or is a journal's line with bars. Pages of a
    key are counted after one row for each page and key, so that a line on every page of a
    very long document does not gather in one task.
    """
    t = F.trim("text")
    outer = lines.where((F.col("y1") < F.col("height") * 0.09) | (F.col("y0") > F.col("height") * 0.91)).withColumn("key", X.furniture_key(F.col("text")))
    seen = outer.groupBy("doc_id", "key", "page").agg(F.lit(1).alias("one")).groupBy("doc_id", "key").agg(F.count("*").alias("seen"))
    pages = lines.groupBy("doc_id", "page").agg(F.lit(1).alias("one")).groupBy("doc_id").agg(F.count("*").alias("pages"))
    rows = outer.join(seen, ["doc_id", "key"]).join(pages, "doc_id")
    words = X.words(t)
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    why = (
        F.when(t.rlike(X.LINE_CLASSES["page_number"]), "page_number")
        .when((F.col("pages") >= 2) & (F.col("seen") >= F.greatest(F.lit(2), F.col("pages") * F.lit(0.4))) & (F.length(t) > 2) & (F.col("key") != "0"), "repeated")
        .when(t.rlike(r"^(?:[0-9]{1,4}\s+\S.*|.*\S\s+[0-9]{1,4})$") & (F.size(words) <= 10) & (F.col("seen") >= 2), "running_head")
        .when((F.size(words) >= 8) & (single >= F.size(words) * F.lit(0.6)) & t.rlike(r"(?:(?<![\p{L}\p{N}_])[A-Za-z0-9] ){5,}[A-Za-z0-9](?![\p{L}\p{N}_])"), "spaced")
        .when((F.regexp_count(t, F.lit(r" \| ")) >= 2) & t.rlike("[0-9]") & (F.size(words) <= 16), "barred")
    )
    return rows.withColumn("why", why).where("why is not null").select("doc_id", "page", "seq", "text", "why")


BARE_NUMBER = r"^[-–]?\s*[0-9]{1,4}\s*[-–]?$"


def page_numbers(lines: DataFrame) -> DataFrame:
    """Bare numbers that are a page's first or last line, in its outer fifth, well clear of the rest, or its only line."""
    page = ["doc_id", "page"]
    everything = W.partitionBy(*page)
    down, up = everything.orderBy(F.col("y1").desc(), "seq"), everything.orderBy("y0", "seq")
    rows = lines.select(
        "*",
        F.count("*").over(everything).alias("n"),
        F.row_number().over(down).alias("last"),
        F.lead("y1").over(down).alias("above"),
        F.row_number().over(up).alias("first"),
        F.lead("y0").over(up).alias("below"),
    )
    clear = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")) * 0.8
    bare = F.trim("text").rlike(BARE_NUMBER)
    foot = (F.col("last") == 1) & (F.col("y0") >= F.col("height") * 0.8) & (F.col("y0") - F.col("above") >= clear)
    head = (F.col("first") == 1) & (F.col("y1") <= F.col("height") * 0.2) & (F.col("below") - F.col("y1") >= clear)
    return rows.where(bare & ((F.col("n") == 1) | ((F.col("n") >= 3) & (foot | head)))).select(*page, "seq", "text")


def reference_scope(blocks: DataFrame) -> DataFrame:
    """Blocks with paragraphs and list items under a heading of references turned into references.

    The scope ends at the next heading of the same or a higher level. Two running windows:
    the last such heading, then the highest level since.
    """
    order = W.partitionBy("doc_id").orderBy("seq")
    heading = F.col("kind").isin("heading", "title")
    level = F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))
    opens = heading & F.col("text").rlike(X.LINE_CLASSES["reference_heading"])
    rows = blocks.withColumn("__group", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    rows = rows.withColumn("__open", F.last(F.when(opens, level), ignorenulls=True).over(order))
    since = W.partitionBy("doc_id", "__group").orderBy("seq")
    rows = rows.withColumn("__least", F.min(F.when(heading & ~opens, level)).over(since))
    inside = (F.col("__group") > 0) & (F.col("__least").isNull() | (F.col("__least") > F.col("__open")))
    kind = F.when(inside & F.col("kind").isin("paragraph", "list_item"), "reference").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).drop("__group", "__open", "__least")


def split_references(blocks: DataFrame) -> DataFrame:
    """References that hold several "[n]" entries, one row for each, with its offset in the block."""
    parts = F.split("text", r"(?<=\s)(?=\[[0-9]{1,4}\]\s)", -1)
    sized = F.transform(parts, lambda p: F.length(p))
    starts = F.transform(sized, lambda n, i: F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    rows = blocks.withColumn("__p", F.explode(F.arrays_zip(parts.alias("p"), starts.alias("s"))))
    lead = F.length("__p.p") - F.length(F.ltrim("__p.p"))
    return rows.withColumn("offset", F.col("__p.s") + lead).withColumn("text", F.trim("__p.p")).where("text <> ''").drop("__p")


def heading_levels(headings: DataFrame) -> DataFrame:
    """Levels of ``headings`` (doc_id, seq, size, numbered) without one: by their number, else by their size.

    Sizes are ranked from the largest, 4 at most; a size that numbered headings have takes
    their highest level.
    """
    size = F.bround("size", 0)
    rows = headings.withColumn("__size", size)
    ranked = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("__size").desc()))
    shared = F.min("numbered").over(W.partitionBy("doc_id", "__size"))
    return rows.withColumn("level", F.coalesce("numbered", shared, F.least(F.lit(4), ranked))).drop("__size")


def number_depth(text):
    """The level that a heading's own number gives ("2.1" is 2), or null."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def line_gap(lines: DataFrame) -> DataFrame:
    """(doc_id, page, gap): the median gap where a sentence goes on, else of all pairs of lines, else a quarter of the size."""
    order = W.partitionBy("doc_id", "page").orderBy("seq")
    rows = lines.select("*", *(F.lead(c).over(order).alias(f"n_{c}") for c in ("y0", "x0", "text")))
    gap = F.col("n_y0") - F.col("y1")
    near = (gap >= 0) & (gap < F.col("size") * 1.5) & (F.abs(F.col("x0") - F.col("n_x0")) < F.col("size") * 3)
    goes_on = F.col("n_text").rlike(r"^\p{Ll}") & ~F.trim("text").rlike(r"[.!?:;\"”’)]$")
    pairs = rows.groupBy("doc_id", "page").agg(
        F.percentile(F.when(near & goes_on, gap), 0.5).alias("own"), F.percentile(F.when(near, gap), 0.5).alias("all"), F.max_by("size", -F.col("seq")).alias("size")
    )
    return pairs.select("doc_id", "page", F.coalesce("own", "all", F.col("size") * 0.25).alias("gap"))


def interleaved(lines: DataFrame, steps: int = 3) -> DataFrame:
    """(doc_id, page, steps, mixed): how often a line of prose is followed by one beside it at the same height."""
    order = W.partitionBy("doc_id", "page").orderBy("seq")
    rows = lines.select("*", *(F.lead(c).over(order).alias(f"n_{c}") for c in ("x0", "y0", "x1", "y1", "text")))
    overlap = F.least("y1", "n_y1") - F.greatest("y0", "n_y0")
    beside = (F.col("n_x0") >= F.col("x1") - 1) | (F.col("x0") >= F.col("n_x1") - 1)
    prose = (F.size(X.words(F.col("text"))) >= 5) & (F.size(X.words(F.col("n_text"))) >= 5)
    step = beside & prose & (overlap > F.least(F.col("y1") - F.col("y0"), F.col("n_y1") - F.col("n_y0")) * 0.5)
    return rows.groupBy("doc_id", "page").agg(F.count_if(step).alias("steps")).withColumn("mixed", F.col("steps") >= steps)


def box_sections(items: DataFrame) -> DataFrame:
    """Items with a heading of an abstract, and the paragraphs right after it, made a box; ``keep`` marks what stays with the next."""
    order = W.partitionBy("doc_id").orderBy("seq")
    opens = (F.col("kind") == "heading") & F.col("text").rlike(r"(?i)^\s*(?:abstract|samenvatting|summary)(?![\p{L}\p{N}_])")
    # an island is a heading with the paragraphs after it
    rows = items.withColumn("__island", F.sum(F.when(opens | (F.col("kind") != "paragraph"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("__box", F.first(opens).over(W.partitionBy("doc_id", "__island").orderBy("seq")))
    kind = F.when(opens, "box_heading").when(F.col("__box") & (F.col("kind") == "paragraph"), "box_paragraph").otherwise(F.col("kind"))
    keep = F.col("kind").isin("heading", "title") | ((F.col("kind") == "image") & (F.lead("kind").over(order) == "caption"))
    return rows.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn("kind", kind).drop("__island", "__box")


def attach_markers(blocks: DataFrame) -> DataFrame:
    """Lone raised marks put back in front of the block beside them (doc_id, page, seq, text, x0, y0, x1, y1, size)."""
    order = W.partitionBy("doc_id", "page").orderBy("seq")
    mark = r"^(?:[a-z](?:,[a-z])*|[0-9]{1,2}|[∗*†‡§¶])$"
    rows = blocks.select("*", *(F.lead(c).over(order).alias(f"n_{c}") for c in ("x0", "y0", "size")), *(F.lag(c).over(order).alias(f"p_{c}") for c in ("x1", "y0", "size", "text")))
    beside = (F.col("n_x0") - F.col("x1")).between(0, F.col("n_size") * 2 - 1e-9) & (F.abs(F.col("n_y0") - F.col("y0")) < F.greatest("n_size", F.lit(4.0)))
    gone = F.trim("text").rlike(mark) & beside & (F.col("size") < F.col("n_size"))
    behind = (F.col("x0") - F.col("p_x1")).between(0, F.col("size") * 2 - 1e-9) & (F.abs(F.col("y0") - F.col("p_y0")) < F.greatest("size", F.lit(4.0)))
    has = F.trim("p_text").rlike(mark) & behind & (F.col("p_size") < F.col("size"))
    rows = rows.withColumn("__gone", F.coalesce(gone, F.lit(False))).withColumn("__has", F.coalesce(has, F.lit(False)) & ~F.coalesce(gone, F.lit(False)))
    rows = rows.withColumn("marker", F.when(F.col("__has"), F.trim("p_text")))
    return rows.where("not __gone").withColumn("text", F.when(F.col("__has"), F.concat_ws(" ", F.trim("p_text"), "text")).otherwise(F.col("text"))).select(*blocks.columns, "marker")


def caption_order(blocks: DataFrame) -> DataFrame:
    """``place`` of blocks with captions moved: a figure's after it, a table's before it (doc_id, block_id, seq, kind, caption_for)."""
    target = blocks.select("doc_id", F.col("block_id").alias("caption_for"), F.col("seq").alias("t_seq"), F.col("kind").alias("t_kind"))
    rows = blocks.join(target, ["doc_id", "caption_for"], "left")
    moved = (F.col("kind") == "caption") & F.col("t_seq").isNotNull()
    side = F.when(~moved, 0).when(F.col("t_kind") == "table", -1).otherwise(1)
    order = W.partitionBy("doc_id").orderBy(F.when(moved, F.col("t_seq")).otherwise(F.col("seq")), side, "seq")
    return rows.withColumn("place", F.row_number().over(order)).drop("t_seq", "t_kind")


def block_order(blocks: DataFrame) -> DataFrame:
    """``place`` of blocks by page: the body, then furniture, then footnotes."""
    zone = F.when(F.col("kind") == "furniture", 1).when(F.col("kind") == "footnote", 2).otherwise(0)
    return blocks.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("page", zone, "seq")))


def quote_margins(blocks: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page, seq, text, x0, x1, size, body) that are quotations: set in or smaller, with a line that names the author."""
    page = W.partitionBy("doc_id", "page")
    order = page.orderBy("seq")
    wide = F.length("text") > 200
    median = lambda c: F.get(F.sort_array(F.collect_list(F.when(wide, F.col(c))).over(page)), F.floor(F.count_if(wide).over(page) / 2).cast("int"))
    rows = blocks.withColumn("left", median("x0")).withColumn("right", median("x1")).where("left is not null")
    rows = rows.select("*", F.lead("text").over(order).alias("n_text"))
    named = lambda c: F.trim(c).rlike("^[—–]") & (F.size(X.words(F.col(c))) <= 18)
    attribution = F.trim("text").rlike("^[—–-]") & (F.size(X.words(F.col("text"))) <= 18)
    indented = (F.col("x0") > F.col("left") + F.col("body") * 1.2) & (F.col("x1") < F.col("right") - F.col("body") * 1.2)
    smaller = F.col("size") <= F.col("body") * 0.9
    follows = F.coalesce(named("n_text"), F.lit(False))
    first = (indented & (smaller | follows)) | (smaller & follows)
    rows = rows.withColumn("__own", first).withColumn("__name", attribution & (smaller | indented))
    before = F.coalesce(F.lag(F.col("__own") | F.col("__name")).over(order), F.lit(False))
    return rows.where(F.col("__own") | F.col("__name") | (attribution & before)).select("doc_id", "page", "seq")


def paragraphs(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, n, page, text, y0, y1) with ``para``: a new one after a wide gap, or a sentence's end before a new page."""
    order = W.partitionBy("doc_id").orderBy("n")
    rows = words.select("*", *(F.lag(c).over(order).alias(f"p_{c}") for c in ("page", "text", "y0", "y1")))
    turned = (F.col("page") != F.col("p_page")) & F.regexp_replace("p_text", "[\"'”’)]+$", "").rlike("[.!?:]$")
    gap = (F.col("page") == F.col("p_page")) & (F.col("y0") - F.col("p_y1") > F.greatest(F.lit(1.0), F.col("p_y1") - F.col("p_y0")) * 0.8)
    new = F.when(F.col("p_page").isNotNull() & (turned | gap), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("para", F.sum("__new").over(order)).select(*words.columns, "para")


def bands(rects: DataFrame, gap: float = 12.0) -> DataFrame:
    """(keys, x0, y0, x1, y1): rectangles of neighbouring words on one line, joined; ``rects`` has doc_id, key and a box."""
    line = F.bround((F.col("y0") + F.col("y1")) / 2, 0)
    order = W.partitionBy("doc_id", "key", "line").orderBy("x0", "x1")
    rows = rects.withColumn("line", line).withColumn("reach", F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("band", F.sum(F.when(F.col("x0") - F.col("reach") > gap, 1).otherwise(0)).over(order))
    return rows.groupBy("doc_id", "key", "line", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("band")


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): page numbers as "3-5, 9"."""
    rows = pages.select("doc_id", "page").distinct()
    island = F.col("page") - F.row_number().over(W.partitionBy("doc_id").orderBy("page"))
    runs = rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("z"))
    shown = F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "z"))
    listed = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))).alias("x"))
    return listed.select("doc_id", F.array_join(F.transform("x", lambda r: r["s"]), ", ").alias("pages"))


def title_block(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, text): the largest type of the first two pages, if it stands in the upper half and out from the body."""
    first = blocks.where(F.col("kind").isin("heading", "paragraph")).join(blocks.groupBy("doc_id").agg(F.min("page").alias("page0")), "doc_id").where("page <= page0 + 1")
    best = first.groupBy("doc_id").agg(F.max_by(F.struct("seq", "text", "size", "y0", "height", "body"), F.struct("size", -F.col("seq"))).alias("b"))
    return best.where("b.size >= b.body * 1.25 and b.y0 <= 0.5 * b.height").select("doc_id", "b.seq", "b.text")


def mastheads(lines: DataFrame) -> DataFrame:
    """Lines of a publisher's masthead in a page's first quarter, and all between its first and last one."""
    page = W.partitionBy("doc_id", "page")
    t = F.trim("text")
    top = lines.where(F.col("y1") < F.col("height") * 0.25)
    journal = (F.col("y1") < F.col("height") * 0.12) & t.rlike(r"^[A-Z][\p{L}\p{N}_&.,:'’ -]{2,80}\s[0-9]{1,4}\s\((?:19|20)[0-9]{2}\)\s[A-Za-z]?[0-9]+(?:\s?[–-]\s?[0-9]+)?$")
    begins, ends = F.lower(t).startswith("contents lists available"), F.lower(t).startswith("journal homepage")
    rows = top.withColumn("from", F.min_by(F.when(begins, F.col("y0")), F.when(begins, F.col("seq"))).over(page)).withColumn("to", F.min_by(F.when(ends, F.col("y1")), F.when(ends, F.col("seq"))).over(page))
    between = (F.col("y0") >= F.col("from")) & (F.col("y1") <= F.col("to"))
    return rows.where(t.rlike(X.LINE_CLASSES["masthead"]) | journal | F.coalesce(between, F.lit(False))).select("doc_id", "page", "seq", "text")


def lines_outside(lines: DataFrame, regions: DataFrame, share: float = 0.6) -> DataFrame:
    """Lines (doc_id, page, box) of which no region of their page covers more than ``share``."""
    from .links import covers_more

    return lines.alias("a").join(regions.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & covers_more("a", "b", share), "left_anti")


def marked_words(words: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, page, first, last, reason): words (n, box) under a mark (id, box, reason), neighbours of one reason together."""
    a, b = words.alias("a"), marks.alias("b")
    level = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0") > F.greatest(F.lit(0.1), F.col("a.y1") - F.col("a.y0")) * 0.3
    meet = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0") > 1.0) & level
    hit = a.join(b, meet).groupBy("a.doc_id", "a.page", "a.n").agg(F.min_by("b.reason", "b.id").alias("reason"))
    island = F.col("n") - F.row_number().over(W.partitionBy("doc_id", "page", "reason").orderBy("n"))
    return hit.withColumn("island", island).groupBy("doc_id", "page", "reason", "island").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("island")


def split_heading_level(text, common):
    """The level of a heading split off a paragraph: by its number, three at most, else the document's most common."""
    number = F.regexp_extract(F.concat(text, F.lit(" ")), r"^([0-9]+(?:\.[0-9]+)*)\.?\s", 1)
    return F.when(number != "", F.least(F.lit(3), F.size(F.split(number, r"\.")))).otherwise(F.coalesce(common, F.lit(1)))
