"""Web pages (page_id, url, html) as articles and blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import html as H

BLOCKS = "page_id long, seq int, kind string, level int, text string, styles array<struct<start int, end int, style string>>, cells array<array<string>>"
ARTICLES = "page_id long, title string, lang string, html string"


def _mapped(rows: DataFrame, schema: str, each) -> DataFrame:
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                made = [r for row in zip(*(c.to_pylist() for c in b.slice(k, 128).columns)) for r in each(*row)]
                columns = list(zip(*made)) if made else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every page's blocks in order; tables have their cells."""

    def each(i, html):
        for seq, b in enumerate(H.blocks(html or "")):
            yield i, seq, b.kind, b.level, b.text, [{"start": s, "end": e, "style": k} for s, e, k in b.styles], b.rows

    return _mapped(pages.select(F.col(id_col).cast("long").alias("page_id"), html_col), BLOCKS, each)


def articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The article of every page that has one."""

    def each(i, html):
        found = H.article(html or "")
        return [(i, *found)] if found else []

    return _mapped(pages.select(F.col(id_col).cast("long").alias("page_id"), html_col), ARTICLES, each)


def metadata(html: Column) -> Column:
    """struct<title, lang> by expressions alone."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(sign))
    lang = F.lower(F.regexp_extract(html, r"<html[^>]*\slang=[\"']?([a-zA-Z]{2})", 1))
    return F.struct(F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.when(lang != "", lang).otherwise("en").alias("lang"))


def normalise_url(text: Column) -> Column:
    """A typed address made complete, or null if it is none of a web page."""
    t = F.trim(text)
    url = F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    fine = F.contains(host, F.lit(".")) | (host == "localhost")
    return F.when((t != "") & url.rlike(r"(?i)^https?://") & fine, url)


def file_name(title: Column, url: Column) -> Column:
    """The name under which an article is kept: its title and a short hash of its address."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    bare = lambda c: F.trim(F.regexp_replace(F.substring(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", "")), 1, 60), r"\s+", " "))
    named = bare(F.when(title != "", title).otherwise(host))
    return F.concat(F.when(named != "", named).otherwise("web page"), F.lit(" ("), F.substring(F.sha1(url), 1, 8), F.lit(").html"))


def wiki_api(url: Column) -> Column:
    """The address at which a wiki gives an article alone, or null for other pages."""
    lang = F.lower(F.regexp_extract(url, r"(?i)^(?:https?://)?([a-z][a-z0-9-]*)\.(?:m\.)?wikipedia\.org/wiki/[^?#]+", 1))
    page = F.regexp_extract(url, r"(?i)^(?:https?://)?[a-z][a-z0-9-]*\.(?:m\.)?wikipedia\.org/wiki/([^?#]+)", 1)
    name = F.replace(F.url_encode(F.replace(F.url_decode(page), F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    return F.when(page != "", F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/w/rest.php/v1/page/"), name, F.lit("/html")))
