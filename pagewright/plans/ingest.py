"""Queries of web pages and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compose as C
from ..operators.blocks import lines, table
from ..sources import pages as P
from .registry import BLOCKS, query


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '\s+', ' ', 'g')) as title,
  coalesce(nullif(lower(regexp_extract(html, '<html[^>]*\slang=["'']?([a-zA-Z]{2})', 1)), ''), 'en') as lang from pages""")
def a25_page_metadata(spark, sf_dir):
    """Titles and languages of pages."""
    return table(spark, sf_dir, "pages").select("page_id", P.metadata(F.col("html")).alias("m")).select("page_id", "m.title", "m.lang")


@query(r"""with bare as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<b>', chr(1), 'g'), '</?a(?:\s[^>]*)?>', '', 'g') as x from pages),
pieces as (select page_id, generate_subscripts(m, 1) as nr, unnest(m) as mark, unnest(s) as raw from (select page_id, regexp_extract_all(x, '(<[/!]?[a-zA-Z0-9]+)[^>]*>[^<]*', 1) as m, regexp_extract_all(x, '<[/!]?[a-zA-Z0-9]+[^>]*>([^<]*)', 1) as s from bare)),
said as (select page_id, nr, mark, contains(raw, chr(1)) as bold, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(raw, chr(1), ''), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as t from pieces),
kinds as (select page_id, nr, bold, t, case when mark = '<li' then 'list_item' when regexp_matches(mark, '^<h[1-6]$') then 'heading' else 'paragraph' end as kind, case when regexp_matches(mark, '^<h[1-6]$') then substr(mark, 3)::int else 0 end as level from said where t <> '')
select page_id, (row_number() over (partition by page_id order by nr) - 1)::int as seq, kind, level, case kind when 'list_item' then '• ' else '' end || t as text, bold::int as n_styles, 0 as n_rows from kinds""")
def a24_page_blocks(spark, sf_dir):
    """Blocks of pages."""
    return P.blocks(table(spark, sf_dir, "pages")).select("page_id", "seq", "kind", "level", "text", F.size("styles").alias("n_styles"), F.size("cells").alias("n_rows"))


@query(r"""with a as (select page_id, html, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) as body, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as h1 from pages)
select page_id, trim(regexp_replace(replace(h1, '&amp;', '&'), '\s+', ' ', 'g')) as title, lower(regexp_extract(html, '<html[^>]*\slang="([a-zA-Z]+)"', 1)) as lang,
  length(trim(regexp_replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) as n_chars from a where length(trim(regexp_replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) >= 200""")
def a29_articles(spark, sf_dir):
    """Articles of pages, with their titles (A30)."""
    found = P.articles(table(spark, sf_dir, "pages"))
    bare = F.replace(F.regexp_replace("html", "<[^>]*>", ""), F.lit("&amp;"), F.lit("&"))
    return found.select("page_id", "title", "lang", F.length(X.tidy(bare)).cast("long").alias("n_chars"))


@query(r"""with u as (select page_id, case page_id % 4 when 0 then regexp_replace(url, '^https?://', '') when 1 then '  ' || url when 2 then 'no page' else url end as typed, url from pages),
n as (select *, case when regexp_matches(trim(typed), '(?i)^[a-z][a-z0-9+.-]*://') then trim(typed) else 'https://' || trim(typed) end as full_ from u)
select page_id, case when contains(regexp_extract(full_, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.') then full_ end as url,
  trim(regexp_replace(substr(trim(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '[^\p{L}\p{N}_\s-]', '', 'g')), 1, 60), '\s+', ' ', 'g')) || ' (' || sha1(url)[1:8] || ').html' as file from n""")
def a27_addresses(spark, sf_dir):
    """Typed addresses made complete, and names of kept files (A28)."""
    i = F.col("page_id") % 4
    typed = F.when(i == 0, F.regexp_replace("url", "^https?://", "")).when(i == 1, F.concat(F.lit("  "), F.col("url"))).when(i == 2, "no page").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", P.normalise_url(typed).alias("url"), P.file_name(F.lit(""), F.col("url")).alias("file"))


_ITEMS = r"""items as (select doc_id, seq, case when seq = 0 then 'title' when seq % 7 = 3 then 'heading' when seq % 5 = 4 then 'list_item' when seq % 11 = 6 then 'quote' else 'paragraph' end as kind, trim(text) as text, 1 + seq % 3 as level, case when seq % 5 = 4 and seq > 0 and seq % 7 <> 3 then '•' else '' end as marker from blocks where trim(text) <> '')"""


def _items(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents")).where("trim(text) <> ''")
    kind = F.expr("case when seq = 0 then 'title' when seq % 7 = 3 then 'heading' when seq % 5 = 4 then 'list_item' when seq % 11 = 6 then 'quote' else 'paragraph' end")
    rows = rows.select("doc_id", "seq", kind.alias("kind"), F.trim("text").alias("text"), F.expr("1 + seq % 3").alias("level"))
    return rows.withColumn("marker", F.when(F.col("kind") == "list_item", "•").otherwise(""))


@query(f"""with {BLOCKS}, {_ITEMS}, shown as (select doc_id, seq, case when kind in ('title', 'heading') then text || chr(10) || repeat(case kind when 'title' then '=' else '-' end, least(length(text), 60)) when kind = 'list_item' then '• ' || text else text end as t from items)
select doc_id, sum(length(t))::bigint + 2 * count(*) - 1 as n_chars, md5(string_agg(t, chr(10) || chr(10) order by seq) || chr(10)) as file from shown group by doc_id""")
def b02_text_files(spark, sf_dir):
    """Documents as plain text."""
    made = C.text_files(_items(spark, sf_dir))
    return made.select("doc_id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("file"))


_ESC = "replace(replace(text, '*', '\\*'), '_', '\\_')"


@query(f"""with {BLOCKS}, {_ITEMS}, shown as (select doc_id, seq, case kind when 'title' then '# ' || text when 'heading' then repeat('#', least(6, level + 1)::int) || ' ' || text when 'list_item' then '- ' || {_ESC} when 'quote' then '> ' || {_ESC} else {_ESC} end as t from items)
select doc_id, sum(length(t))::bigint + 2 * count(*) - 1 as n_chars, md5(string_agg(t, chr(10) || chr(10) order by seq) || chr(10)) as file from shown group by doc_id""")
def b03_markdown_files(spark, sf_dir):
    """Documents as Markdown."""
    made = C.markdown_files(_items(spark, sf_dir))
    return made.select("doc_id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("file"))


@query(f"""with {BLOCKS}, {_ITEMS}, c as (select doc_id, seq, kind, text, sum(case when kind = 'title' or (kind = 'heading' and level = 1) then 1 else 0 end) over (partition by doc_id order by seq) as chapter from items)
select doc_id, chapter::bigint as chapter, count(*) as n_items, md5(string_agg(text, chr(10) order by seq)) as texts from c group by all""")
def b04_chapters(spark, sf_dir):
    """Chapters of books made from documents."""
    rows = C.chapters(_items(spark, sf_dir))
    listed = rows.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return listed.select("doc_id", "chapter", "n_items", F.md5(F.array_join(F.transform("x", lambda v: v["text"]), "\n")).alias("texts"))


_RUNS = """r as (select l_orderkey as doc_id, [0, 4, 9, 15, 20] as base, (l_partkey % 16)::int as s, (l_partkey % 16 + 1 + l_suppkey % 8)::int as e, case l_linenumber % 3 when 0 then 'bold' when 1 then 'italic' else 'math' end as k from lineitem),
ch as (select d.doc_id, i, substr('abcdefghijklmnopqrstuvwxy', i + 1, 1) as c, coalesce(bool_or(r.k = 'bold'), false) as b, coalesce(bool_or(r.k = 'italic'), false) as it, coalesce(bool_or(r.k = 'math'), false) as m
  from (select distinct l_orderkey as doc_id, i from lineitem, (select unnest(generate_series(0, 24)) as i)) d left join r on r.doc_id = d.doc_id and r.s <= d.i and d.i < r.e group by all),
g as (select *, case when lag(b) over w is distinct from b or lag(it) over w is distinct from it or lag(m) over w is distinct from m then 1 else 0 end as new from ch window w as (partition by doc_id order by i)),
n as (select *, sum(new) over (partition by doc_id order by i) as run from g)"""


@query(f"""with {_RUNS} select doc_id, run - 1 as n, string_agg(c, '' order by i) as text, any_value(b) as bold, any_value(it) as italic, any_value(m) as math from n group by doc_id, run""")
def i20_style_runs(spark, sf_dir):
    """A text cut into runs of one style each, by made-up ranges."""
    style = F.struct(
        F.expr("cast(l_partkey % 16 as int)").alias("start"), F.expr("cast(l_partkey % 16 + 1 + l_suppkey % 8 as int)").alias("end"),
        (F.col("l_linenumber") % 3 == 0).alias("bold"), (F.col("l_linenumber") % 3 == 1).alias("italic"), F.lit(False).alias("superscript"), F.lit(False).alias("subscript"), (F.col("l_linenumber") % 3 == 2).alias("math"),
    )
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(style).alias("styles"))
    runs = rows.select("doc_id", F.posexplode(C.runs(F.lit("abcdefghijklmnopqrstuvwxy"), F.col("styles"))).alias("n", "r"))
    return runs.select("doc_id", F.col("n").cast("long").alias("n"), "r.text", "r.bold", "r.italic", "r.math")
