"""Queries of structure: lines, blocks, headings, references, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import text as X
from ..operators import structure as S
from ..operators.blocks import lines, table
from .registry import BLOCKS, query

_RN = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
# Positioned lines made from order lines.
_LINES = f"""ln as (select doc_id, (seq - 1) // 4 as page, seq, 50 + (p % 3) * 200.0 as x0, 200 + (p % 3) * 200.0 as x1, 60.0 + ((seq - 1) % 4) * 14 + s % 3 as y0, 70.0 + ((seq - 1) % 4) * 14 + s % 3 as y1, 9 + (p % 4) * 0.5 as size,
  case when p % 2 = 0 then 'some words go on here' else 'Another line of text stops.' end as text, p, s, n from (select l_orderkey as doc_id, {_RN} as seq, l_partkey as p, l_suppkey as s, l_linenumber as n from lineitem))"""


def _rows(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))


def _lines(spark, sf_dir):
    y = F.expr("60.0D + ((seq - 1) % 4) * 14 + s % 3")
    return _rows(spark, sf_dir).select(
        "doc_id", F.expr("(seq - 1) div 4").alias("page"), "seq", F.expr("50 + (p % 3) * 200.0D").alias("x0"), F.expr("200 + (p % 3) * 200.0D").alias("x1"), y.alias("y0"), (y + 10).alias("y1"), F.expr("9 + (p % 4) * 0.5D").alias("size"),
        F.when(F.col("p") % 2 == 0, "some words go on here").otherwise("Another line of text stops.").alias("text"), "p", "s", "n",
    )


@query(f"""with {_LINES}, z as (select doc_id, round_even(size * 2, 0) / 2 as body, sum(length(text)) as n, min(seq) as first from ln group by all) select doc_id, arg_max(body, n * 1000 - first)::double as body from z group by doc_id""")
def e01_body_sizes(spark, sf_dir):
    """Each made-up document's body size."""
    return S.body_size(_lines(spark, sf_dir), "doc_id")


_KEY = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(trim(b.text)), '[^\p{L}\p{N}_\s]|\p{Nd}', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ')"


_FEET = """made as (select source as doc, doc_id as page, length(text) - length(replace(text, chr(10), '')) + 1 as n, doc_id from documents),
feet as (select doc, page, n as seq, case doc_id % 5 when 0 then '- ' || (doc_id % 400) || ' -' when 1 then 'Annals of ' || doc || ' ' || (doc_id % 50) when 2 then 'a b c d e f g h i j' when 3 then 'Vol. 3 | No. 4 | 2019' else 'no foot' end as text from made
  union all select doc, page, n + 1, case when doc_id % 5 < 3 then 'Proceedings of the ' || doc else 'a line of its own ' || doc_id || ' words' end from made)"""


@query(rf"""with {BLOCKS}, {_FEET}, last as (select doc_id, max(seq) as z from blocks group by doc_id),
outer_ as (select doc, page, seq, text, trim(text) as t, case when {_KEY} = '' then '0' else {_KEY} end as key, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') as w
  from (select d.source as doc, b.doc_id as page, b.seq, b.text from blocks b join last l using (doc_id) join documents d using (doc_id) where b.seq = 0 or b.seq = l.z union all select doc, page, seq, text from feet) b),
seen as (select doc, key, count(distinct page) as seen from outer_ group by all), np as (select source as doc, count(distinct doc_id) as pages from documents group by all),
y as (select o.*, case when regexp_matches(t, '{X.LINE_CLASSES["page_number"]}') then 'page_number' when pages >= 2 and seen >= greatest(2, pages * 0.4::double) and length(t) > 2 and key <> '0' then 'repeated'
  when regexp_matches(t, '^(?:[0-9]{{1,4}}\s+\S.*|.*\S\s+[0-9]{{1,4}})$') and len(w) <= 10 and seen >= 2 then 'running_head' when len(w) >= 8 and len(list_filter(w, lambda x: length(x) = 1)) >= len(w) * 0.6::double and regexp_matches(t, '(?:(^|[^\p{{L}}\p{{N}}_])[A-Za-z0-9] ){{5,}}') then 'spaced'
  when len(regexp_extract_all(t, ' \| ')) >= 2 and regexp_matches(t, '[0-9]') and len(w) <= 16 then 'barred' end as why from outer_ o join seen using (doc, key) join np using (doc))
select doc as doc_id, page, seq, text, why from y where why is not null""")
def e04_furniture(spark, sf_dir):
    """Running heads and feet where a source's documents are its pages, each with two made-up lines at its foot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc"), "text").withColumn("n", F.size(F.split("text", "\n")))
    rows = docs.select("doc", "doc_id", "n", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    i = F.col("doc_id") % 5
    said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    number = lambda m: (F.col("doc_id") % m).cast("string")
    foot = F.when(i == 0, said("- ", number(400), " -")).when(i == 1, said("Annals of ", F.col("doc"), " ", number(50))).when(i == 2, "a b c d e f g h i j").when(i == 3, "Vol. 3 | No. 4 | 2019").otherwise("no foot")
    under = F.when(i < 3, said("Proceedings of the ", F.col("doc"))).otherwise(said("a line of its own ", F.col("doc_id").cast("string"), " words"))
    feet = docs.select("doc", "doc_id", "n", F.inline(F.array(F.struct(F.col("n").alias("seq"), foot.alias("text")), F.struct((F.col("n") + 1).alias("seq"), under.alias("text")))))
    y = F.when(F.col("seq") == 0, 20.0).when(F.col("seq") >= F.col("n") - 1, 780.0).otherwise(400.0)
    placed = rows.unionByName(feet).select(F.col("doc").alias("doc_id"), F.col("doc_id").alias("page"), "seq", "text", y.alias("y0"), (y + 10).alias("y1"), F.lit(800.0).alias("height"))
    return S.furniture(placed).withColumn("seq", F.col("seq").cast("long"))


@query(rf"""with {_LINES}, z as (select *, lead(y0) over w as ny, lead(x0) over w as nx, lead(text) over w as nt from ln window w as (partition by doc_id, page order by seq)),
g as (select *, ny - y1 as gap, ny - y1 >= 0 and ny - y1 < size * 1.5 and abs(x0 - nx) < size * 3 as near, regexp_matches(nt, '^\p{{Ll}}') and not regexp_matches(trim(text), '[.!?:;"”’)]$') as goes from z)
select doc_id, page, coalesce(median(gap) filter (near and goes), median(gap) filter (near), arg_min(size, seq) * 0.25) as gap from g group by all""")
def e10_line_gaps(spark, sf_dir):
    """The usual gap between the lines of made-up pages."""
    return S.line_gap(_lines(spark, sf_dir))


@query(rf"""with {_LINES}, z as (select *, lead(y0) over w as ny0, lead(y1) over w as ny1, lead(x0) over w as nx0, lead(x1) over w as nx1, lead(text) over w as nt from (select *, y0 - ((seq - 1) % 2) * 13 as yy from ln) window w as (partition by doc_id, page order by seq))
select doc_id, page, count_if(nt is not null and (nx0 >= x1 - 1 or x0 >= nx1 - 1) and least(y1, ny1) - greatest(y0, ny0) > 0.5 * least(y1 - y0, ny1 - ny0)) as steps, steps >= 1 as mixed from (select doc_id, page, seq, x0, x1, nx0, nx1, nt, y0, y1, ny0 - 12 as ny0, ny1 - 12 as ny1 from z) group by all""")
def f02_interleaved_pages(spark, sf_dir):
    """Pages where lines of prose stand beside each other (lines moved up by 12 for each step)."""
    rows = _lines(spark, sf_dir).withColumn("y0", F.col("y0") - F.col("seq") * 12).withColumn("y1", F.col("y1") - F.col("seq") * 12)
    return S.interleaved(rows, 1)


_KINDS = f"""bl as (select doc_id, seq, case when p % 5 = 0 then 'heading' when p % 7 = 0 then 'list_item' else 'paragraph' end as kind, case when p % 5 = 0 and s % 2 = 0 then 'References' when p % 5 = 0 then 'Method' else 'text' end as text, (1 + s % 3)::int as level from
  (select l_orderkey as doc_id, {_RN} as seq, l_partkey as p, l_suppkey as s from lineitem))"""


def _kinds(spark, sf_dir):
    kind = F.expr("case when p % 5 = 0 then 'heading' when p % 7 = 0 then 'list_item' else 'paragraph' end")
    text = F.expr("case when p % 5 = 0 and s % 2 = 0 then 'References' when p % 5 = 0 then 'Method' else 'text' end")
    return _rows(spark, sf_dir).select("doc_id", "seq", kind.alias("kind"), text.alias("text"), F.expr("cast(1 + s % 3 as int)").alias("level"))


@query(f"""with {_KINDS}, r as (select b.doc_id, b.seq, b.kind, max(h.seq) as rs from bl b left join bl h on h.doc_id = b.doc_id and h.seq < b.seq and h.text = 'References' group by all),
o as (select r.*, h.level as rl from r left join bl h on h.doc_id = r.doc_id and h.seq = r.rs)
select doc_id, seq, case when kind in ('paragraph', 'list_item') and rs is not null and not exists (select 1 from bl h where h.doc_id = o.doc_id and h.kind = 'heading' and h.text <> 'References' and h.seq > o.rs and h.seq < o.seq and h.level <= o.rl) then 'reference' else kind end as kind from o""")
def c02_reference_scope(spark, sf_dir):
    """Blocks under a heading of references."""
    return S.reference_scope(_kinds(spark, sf_dir)).select("doc_id", "seq", "kind")


@query("""with r as (select o_orderkey as doc_id, '[' || (o_orderkey % 9000 + 1) || '] A. One' as a from orders)
select doc_id, 0 as "offset", 'Intro' as text from r union all select doc_id, 6, a from r union all select doc_id, (7 + length(a))::int, '[2] B.' from r""")
def c03_split_references(spark, sf_dir):
    """References that hold several numbered entries, split."""
    text = F.concat(F.lit("Intro ["), F.expr("cast(o_orderkey % 9000 + 1 as string)"), F.lit("] A. One [2] B."))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return S.split_references(rows).select("doc_id", "offset", "text")


@query(f"""with h as (select l_orderkey as doc_id, {_RN} as seq, 10 + (l_partkey % 6) * 0.7 as size, case when l_suppkey % 4 = 0 then (1 + l_suppkey % 3)::int end as numbered from lineitem)
select doc_id, seq, coalesce(numbered, min(numbered) over (partition by doc_id, round_even(size, 0)), least(4, dense_rank() over (partition by doc_id order by round_even(size, 0) desc)))::int as level from h""")
def e11_heading_levels(spark, sf_dir):
    """Levels of made-up headings."""
    rows = _rows(spark, sf_dir).select("doc_id", "seq", F.expr("10 + (p % 6) * 0.7D").alias("size"), F.expr("case when s % 4 = 0 then cast(1 + s % 3 as int) end").alias("numbered"))
    return S.heading_levels(rows).select("doc_id", "seq", "level")


@query(f"""with it as (select l_orderkey as doc_id, {_RN} as seq, case l_partkey % 4 when 0 then 'heading' when 1 then 'image' when 2 then 'caption' else 'paragraph' end as kind0, case when l_suppkey % 2 = 0 then 'Abstract' else 'Results' end as text from lineitem),
it2 as (select doc_id, seq, case when kind0 = 'caption' and text = 'Results' then 'paragraph' else kind0 end as kind, text from it),
f as (select a.*, (select max(b.seq) from it2 b where b.doc_id = a.doc_id and b.seq <= a.seq and b.kind <> 'paragraph') as z, lead(kind) over (partition by doc_id order by seq) as nk from it2 a)
select f.doc_id, f.seq, case when f.kind = 'heading' and f.text = 'Abstract' then 'box_heading' when f.kind = 'paragraph' and h.kind = 'heading' and h.text = 'Abstract' then 'box_paragraph' else f.kind end as kind,
  coalesce(f.kind in ('heading', 'title') or (f.kind = 'image' and nk = 'caption'), false) as keep from f left join it2 h on h.doc_id = f.doc_id and h.seq = f.z""")
def f22_box_sections(spark, sf_dir):
    """Boxes around abstracts, and what stays with the next item (F23)."""
    kind = F.expr("case p % 4 when 0 then 'heading' when 1 then 'image' when 2 then case when s % 2 = 0 then 'caption' else 'paragraph' end else 'paragraph' end")
    rows = _rows(spark, sf_dir).select("doc_id", "seq", kind.alias("kind"), F.when(F.col("s") % 2 == 0, "Abstract").otherwise("Results").alias("text"))
    return S.box_sections(rows).select("doc_id", "seq", "kind", "keep")


@query(f"""with b as (select l_orderkey as doc_id, {_RN} as seq, l_partkey % 3 as page, case l_suppkey % 3 when 0 then 'footnote' when 1 then 'furniture' else 'paragraph' end as kind from lineitem)
select doc_id, seq, row_number() over (partition by doc_id order by page, case kind when 'furniture' then 1 when 'footnote' then 2 else 0 end, seq)::int as place from b""")
def g01_block_order(spark, sf_dir):
    """Blocks of a page: body, furniture, footnotes."""
    kind = F.expr("case s % 3 when 0 then 'footnote' when 1 then 'furniture' else 'paragraph' end")
    return S.block_order(_rows(spark, sf_dir).select("doc_id", "seq", F.expr("p % 3").alias("page"), kind.alias("kind"))).select("doc_id", "seq", "place")


@query(f"""with b as (select l_orderkey as doc_id, {_RN} as seq, case l_partkey % 4 when 0 then 'caption' when 1 then 'table' when 2 then 'image' else 'paragraph' end as kind, (1 + l_suppkey % 6) as t from lineitem),
r as (select b.*, t.seq as ts, t.kind as tk from b left join b t on b.kind = 'caption' and t.doc_id = b.doc_id and t.seq = b.t and t.kind in ('table', 'image'))
select doc_id, seq, row_number() over (partition by doc_id order by coalesce(ts, seq), case when ts is null then 0 when tk = 'table' then -1 else 1 end, seq)::int as place from r""")
def f26_caption_order(spark, sf_dir):
    """Captions moved next to what they name."""
    kind = F.expr("case p % 4 when 0 then 'caption' when 1 then 'table' when 2 then 'image' else 'paragraph' end")
    rows = _rows(spark, sf_dir).select("doc_id", "seq", F.col("seq").cast("string").alias("block_id"), kind.alias("kind"), F.expr("cast(1 + s % 6 as string)").alias("to"))
    target = rows.where("kind in ('table', 'image')").select("doc_id", F.col("block_id").alias("to"), F.lit(True).alias("there"))
    rows = rows.join(target, ["doc_id", "to"], "left").withColumn("caption_for", F.when((F.col("kind") == "caption") & F.col("there"), F.col("to")))
    return S.caption_order(rows).select("doc_id", "seq", "place")


@query("""with w as (select doc_id, n, (n // 3) as page, case when p % 3 = 0 then 'end.' else 'word' end as text, 100.0 + (n % 3) * (10 + p % 9) as y0, 110.0 + (n % 3) * (10 + p % 9) as y1 from
  (select l_orderkey as doc_id, """ + _RN + """ as n, l_partkey as p from lineitem)),
z as (select *, lag(page) over o as pp, lag(text) over o as pt, lag(y0) over o as py0, lag(y1) over o as py1 from w window o as (partition by doc_id order by n))
select doc_id, n, sum(case when pp is not null and ((page <> pp and regexp_matches(regexp_replace(pt, '["''”’)]+$', ''), '[.!?:]$')) or (page = pp and y0 - py1 > 0.8 * greatest(1, py1 - py0))) then 1 else 0 end) over (partition by doc_id order by n)::bigint as para from z""")
def f14_paragraphs_of_words(spark, sf_dir):
    """The paragraph each made-up word is in."""
    y = F.expr("100.0D + (n % 3) * (10 + p % 9)")
    rows = _rows(spark, sf_dir).drop("n").withColumnRenamed("seq", "n").select("doc_id", "n", F.expr("n div 3").alias("page"), F.when(F.col("p") % 3 == 0, "end.").otherwise("word").alias("text"), y.alias("y0"), (y + 10).alias("y1"))
    return S.paragraphs(rows).select("doc_id", "n", "para")


@query(f"""with w as (select l_orderkey as doc_id, {_RN} as n, (l_partkey % 40) * 10.0 as x0, (l_partkey % 40) * 10.0 + 15 as x1, (l_suppkey % 2) * 20.0 as y0, (l_suppkey % 2) * 20.0 + 10 as y1 from lineitem),
z as (select *, round_even((y0 + y1) / 2, 0) as line, max(x1) over (partition by doc_id, round_even((y0 + y1) / 2, 0) order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from w),
b as (select *, sum(case when x0 - reach > 12 then 1 else 0 end) over (partition by doc_id, line order by x0, x1 rows between unbounded preceding and current row) as band from z) select doc_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by doc_id, line, band""")
def f21_marker_bands(spark, sf_dir):
    """Rectangles of neighbouring words joined."""
    rows = _rows(spark, sf_dir).select("doc_id", F.lit("a").alias("key"), F.expr("(p % 40) * 10.0D").alias("x0"), F.expr("(s % 2) * 20.0D").alias("y0"), F.expr("(p % 40) * 10.0D + 15").alias("x1"), F.expr("(s % 2) * 20.0D + 10").alias("y1"))
    return S.bands(rows).select("doc_id", "x0", "y0", "x1", "y1")


@query("""with p as (select distinct l_orderkey as doc_id, l_partkey % 12 as page from lineitem), g as (select *, page - row_number() over (partition by doc_id order by page) as island from p),
r as (select doc_id, min(page) as a, max(page) as z from g group by doc_id, island) select doc_id, string_agg(case when a = z then a::varchar else a || '-' || z end, ', ' order by a) as pages from r group by doc_id""")
def a19_page_ranges(spark, sf_dir):
    """Made-up page lists as ranges."""
    return S.page_ranges(_rows(spark, sf_dir).select("doc_id", F.expr("p % 12").alias("page")))


@query(f"""with w as (select doc_id, seq, case when s % 2 = 0 then (p % 300)::varchar else 'text' end as text, (case when seq = 1 then 40.0 else 100.0 + seq * 90 end) + p % 20 as y0 from (select l_orderkey as doc_id, {_RN} as seq, l_partkey as p, l_suppkey as s from lineitem)),
l as (select *, y0 + 10 as y1, count(*) over (partition by doc_id) as n from w),
z as (select a.*, (select max(b.y1) from l b where b.doc_id = a.doc_id and b.seq <> a.seq) as top, (select min(b.y0) from l b where b.doc_id = a.doc_id and b.seq <> a.seq) as low from l a)
select doc_id, seq, text from z where text <> 'text' and (n = 1 or (n >= 3 and ((y1 > top and y0 >= 640 and y0 - top >= 8) or (y0 < low and y1 <= 160 and low - y1 >= 8))))""")
def c05_page_numbers(spark, sf_dir):
    """Page numbers inside the margins of made-up pages."""
    y = F.expr("(case when seq = 1 then 40.0D else 100.0D + seq * 90 end) + p % 20")
    rows = _rows(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), "seq", F.expr("case when s % 2 = 0 then cast(p % 300 as string) else 'text' end").alias("text"), y.alias("y0"), (y + 10).alias("y1"), F.lit(800.0).alias("height"))
    return S.page_numbers(rows).select("doc_id", "seq", "text")


@query(f"""with b as (select l_orderkey as doc_id, {_RN} as seq, l_linenumber // 2 as page, case l_partkey % 3 when 0 then 'heading' when 1 then 'paragraph' else 'table' end as kind, 'T' || l_partkey as text, 9.0 + l_partkey % 8 as size, 40.0 + l_suppkey * 37 as y0 from lineitem),
f as (select b.*, min(page) over (partition by doc_id) as p0 from b), c as (select * from f where kind in ('heading', 'paragraph') and page <= p0 + 1), m as (select doc_id, arg_max({{'seq': seq, 'text': text, 'size': size, 'y0': y0}}, size * 1000 - seq) as x from c group by doc_id)
select doc_id, x.seq as seq, x.text as text from m where x.size >= 12.5 and x.y0 <= 400""")
def e18_titles(spark, sf_dir):
    """Titles of made-up documents by type size."""
    kind = F.expr("case p % 3 when 0 then 'heading' when 1 then 'paragraph' else 'table' end")
    rows = _rows(spark, sf_dir).select("doc_id", "seq", F.expr("n div 2").alias("page"), kind.alias("kind"), F.concat(F.lit("T"), F.col("p").cast("string")).alias("text"), F.expr("9.0D + p % 8").alias("size"), F.expr("40.0D + s * 37").alias("y0"), F.lit(10.0).alias("body"), F.lit(800.0).alias("height"))
    return S.title_block(rows)


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 300 as chars, (l_suppkey % 11) / 10.0::double as cover, l_linenumber % 2 = 0 as hidden from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when cover > 0.7 and (chars < 25 or hidden) then 'scanned' when chars < 25 and cover > 0.3 then 'scanned' when chars < 25 then 'text' when cover > 0.5 and chars < 200 then 'mixed' else 'text' end as kind,
  greatest(0, least(chars, 90) - 10) * greatest(0, 50 - l_suppkey) / nullif((chars + 0.0) * 50, 0) as covered from p""")
def a03_page_kinds(spark, sf_dir):
    """Kinds of made-up pages, and the share of a box that another covers (C08)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("chars", F.expr("l_partkey % 300")).withColumn("cover", F.expr("(l_suppkey % 11) / 10.0D")).withColumn("hidden", F.expr("l_linenumber % 2 = 0"))
    inner = (F.lit(0.0), F.lit(0.0), F.col("chars").cast("double"), F.lit(50.0))
    outer = (F.lit(10.0), F.col("l_suppkey").cast("double"), F.lit(90.0), F.lit(60.0))
    share = F.when(F.col("chars") > 0, G.overlap_ratio(inner, outer))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", G.page_kind(F.col("chars"), F.col("cover"), F.col("hidden")).alias("kind"), share.alias("covered"))


@query("""with b as (select l_orderkey as page, (l_partkey % 50) * 10.0 as x0, (l_partkey % 50) * 10.0 + 60 as x1, (l_suppkey % 10) * 70.0 as y0, (l_suppkey % 10) * 70.0 + 120 as y1 from lineitem),
c as (select distinct page, gx, gy from (select page, gx, unnest(generate_series(greatest(0, floor(y0 / 800 * 40))::int, least(40, ceil(least(y1, 800) / 800 * 40))::int - 1)) as gy from (select page, y0, y1, unnest(generate_series(greatest(0, floor(x0 / 600 * 40))::int, least(40, ceil(least(x1, 600) / 600 * 40))::int - 1)) as gx from b)))
select page, count(*) / 1600.0::double as coverage from c group by page""")
def a04_image_coverage(spark, sf_dir):
    """The share of made-up pages that pictures cover, each place once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr("(l_partkey % 50) * 10.0D").alias("x0"), F.expr("(l_suppkey % 10) * 70.0D").alias("y0"), F.expr("(l_partkey % 50) * 10.0D + 60").alias("x1"), F.expr("(l_suppkey % 10) * 70.0D + 120").alias("y1"))
    return G.image_coverage(rows, "page", 600.0, 800.0)


@query("""with g as (select l_orderkey as page, l_partkey % 4 as type, sum(l_suppkey) as n from lineitem group by all) select page, coalesce(sum(n) filter (type = 3), 0) > 0.8 * sum(n) as hidden from g group by page""")
def a05_hidden_layers(spark, sf_dir):
    """Pages whose made-up characters are mostly drawn invisibly."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr("l_partkey % 4").alias("type"), F.col("l_suppkey").alias("n"))
    return G.hidden_layer(rows, "page")


@query("""with p as (select l_suppkey as doc_id, l_partkey % 9 as xref, l_orderkey % 12 as page from lineitem where l_partkey % 9 < 6 or l_orderkey % 12 < 3), n as (select doc_id, count(distinct page) as pages from p group by doc_id),
x as (select doc_id, xref, count(distinct page) as k from p group by all) select doc_id, xref from x join n using (doc_id) where pages >= 3 and k >= 3 and k >= 0.5 * pages""")
def a06_repeated_pictures(spark, sf_dir):
    """Pictures that stand on half of a document's pages."""
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 9 < 6 or l_orderkey % 12 < 3").select(F.col("l_suppkey").alias("doc_id"), F.expr("l_partkey % 9").alias("xref"), F.expr("l_orderkey % 12").alias("page"))
    return G.repeated_pictures(rows)


@query("""with w as (select l_orderkey as page, l_linenumber % 3 as reading, l_partkey % 101 - 5 as conf, l_suppkey % 2 = 0 as across from lineitem), q as (select page, reading, bool_and(across) as across, avg(conf) filter (conf >= 0) as mean, count(*) as n from w group by all)
select page, arg_max(reading, [across::int::double, coalesce(mean, 0), -reading]) as reading, arg_max(n < 15 or coalesce(mean, 0) < 55, [across::int::double, coalesce(mean, 0), -reading]) as poor from q group by page""")
def a13_best_readings(spark, sf_dir):
    """The better of several readings of a page, and whether it is poor (A14)."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr("l_linenumber % 3").alias("reading"), F.expr("cast(l_partkey % 101 - 5 as double)").alias("confidence"), F.expr("l_suppkey % 2 = 0").alias("across"))
    return G.best_reading(words)


@query(r"""with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_linenumber % 4 when 0 then '..' when 1 then 'a' when 2 then 'words here' else 'gap' end as text, l_partkey % 101 - 5 as c, 8.0 + l_suppkey as h from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) = 0 or (length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) <= 3 and m < 40) or (m < 25 and length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 12)) as noise,
  round_even(h / ((case when regexp_matches(text, '[A-Zbdfhijklt0-9(\[{|/]') then 0.72 else 0.5 end) + (case when regexp_matches(text, '[gjpqy,;(\[{|]') then 0.22 else 0.0 end)) * 2, 0) / 2 as size from (select *, case when c >= 0 then c else 100 end as m from t)""")
def a17_noise_lines(spark, sf_dir):
    """Lines that are specks (A17), and type sizes by letter shapes (A38)."""
    text = F.expr("case l_linenumber % 4 when 0 then '..' when 1 then 'a' when 2 then 'words here' else 'gap' end")
    mean = F.expr("case when l_partkey % 101 - 5 >= 0 then l_partkey % 101 - 5 end")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", G.is_noise(text, mean).alias("noise"), G.type_size(text, F.expr("8.0D + l_suppkey")).alias("size"))
