"""Queries of quality ratings, tables, highlights and requests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import highlights as H
from ..operators import links as L
from ..operators import quality as Q
from ..operators import requests as R
from ..operators import tables as T
from ..operators.blocks import lines, table
from .registry import BLOCKS, query

# Confidences, pages and formulas are made from ids by plain arithmetic, alike here and in the SQL.
_WORDS = r"""words as (
  select doc_id, seq, seq // 4 as page, n, w as text, (doc_id * 31 + seq * 17 + n * 7) % 101 as confidence from (
    select doc_id, seq, unnest(x) as w, unnest(generate_series(0, len(x) - 1)) as n from (select doc_id, seq, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as x from blocks) where len(x) > 0)
), lexicon as (select distinct lower(unnest(regexp_extract_all(text, '\p{L}+'))) as word from benchmark),
bare as (select *, trim(text, '.,;:!?()[]"''“”‘’') as b from words),
unsure as (select doc_id, seq, page, n, case when confidence < 50 then 'unclear' else 'unknown' end as reason from bare
  where confidence < 50 or (confidence < 95 and length(b) >= 3 and regexp_full_match(b, '\p{L}+') and lower(b) not in (select word from lexicon)))"""
_STATS = (
    _WORDS
    + r""", p as (select doc_id, seq, seq // 4 as page, trim(text) as t, trim(lead(text) over (partition by doc_id order by seq)) as f from blocks where trim(text) <> ''),
breaks as (select doc_id, page, count(*) as breaks, count_if(not regexp_matches(t, '[.!?:;”"’)\]]$') and regexp_matches(f, '^\p{Ll}')) as split from p where f is not null group by all),
counted as (select doc_id, page, count(*) as words, count(*) as ocr_words from words group by all),
doubts as (select doc_id, page, count(*) as unsure from unsure group by all),
stats as (select c.doc_id, c.page, words, ocr_words, coalesce(unsure, 0) as unsure, (c.doc_id + c.page) % 5 as formulas, coalesce(breaks, 0) as breaks, coalesce(split, 0) as split
  from counted c left join doubts using (doc_id, page) left join breaks using (doc_id, page)),
info as (select distinct doc_id, page, (doc_id + page) % 3 <> 0 as ocr, (doc_id + page) % 7 = 0 as unusual, page // 2 as source_page from words)"""
)


def _level(ocr_words, unsure, ocr, formulas, split, unusual):
    share = f"(case when {ocr_words} > 0 then {unsure} / {ocr_words}::double else 0.0 end)"
    return (
        f"greatest(1, 5 - case when {ocr} then 1 + ({share} > 0.05)::int + ({share} > 0.12)::int + ({share} > 0.30)::int else 0 end - ({formulas} >= 3)::int - ({split} >= 0.15)::int - ({unusual})::int)",
        f"array_to_string(list_filter([case when {ocr} then 'ocr:0' end, case when {ocr} and {unsure} > 0 then 'unsure:' || round_even(100 * {share}, 0)::int end, case when {formulas} >= 3 then 'formulas:' || round_even({formulas}, 0)::int end,"
        f" case when {split} >= 0.15 then 'split:' || round_even(100 * {split}, 0)::int end, case when {unusual} then 'layout:0' end], lambda x: x is not null), ' ')",
    )


def _words(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "seq", F.posexplode(X.words(F.col("text"))).alias("n", "text"))
    return rows.select("doc_id", "seq", F.floor(F.col("seq") / 4).alias("page"), "n", F.col("n").alias("start"), (F.col("n") + 1).alias("end"), "text", F.expr("(doc_id * 31 + seq * 17 + n * 7) % 101").alias("confidence"))


def _lexicon(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()


def _stats(spark, sf_dir):
    words = _words(spark, sf_dir)
    doubts = Q.unsure_words(words, _lexicon(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("unsure"))
    paragraphs = lines(table(spark, sf_dir, "documents")).withColumn("page", F.floor(F.col("seq") / 4))
    counted = words.groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.count("*").alias("ocr_words"))
    rows = counted.join(doubts, ["doc_id", "page"], "left").join(Q.split_breaks(paragraphs), ["doc_id", "page"], "left").na.fill(0)
    return rows.withColumn("formulas", F.expr("(doc_id + page) % 5")).withColumn("unreadable", F.lit(0))


def _info(spark, sf_dir):
    pages = _words(spark, sf_dir).select("doc_id", "page").distinct()
    return pages.select("doc_id", "page", F.expr("(doc_id + page) % 3 <> 0").alias("ocr"), F.expr("(doc_id + page) % 7 = 0").alias("unusual"), F.expr("page div 2").alias("source_page"))


def _shown():
    return F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["number"].cast("int").cast("string"))), " ").alias("reasons")


@query(f"with {BLOCKS}, {_WORDS} select doc_id, seq, n, reason from unsure")
def e05_unsure_words(spark, sf_dir):
    """Words to check, by made-up confidences and the benchmark's words as lexicon."""
    found = Q.unsure_words(_words(spark, sf_dir), _lexicon(spark, sf_dir))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("n").cast("long").alias("n"), "reason")


_PL, _PR = _level("ocr_words", "unsure", "ocr", "formulas", "(case when breaks > 0 then split / breaks::double else 0.0 end)", "unusual")
_RATED = f"rated as (select doc_id, page, source_page, {_PL} as level, {_PR} as reasons from stats join info using (doc_id, page))"


@query(f"with {BLOCKS}, {_STATS}, {_RATED} select doc_id, page, level, reasons from rated")
def e06_page_ratings(spark, sf_dir):
    """Ratings of pages with their reasons."""
    return Q.rate_pages(_stats(spark, sf_dir), _info(spark, sf_dir)).select("doc_id", "page", "level", _shown())


@query(f"with {BLOCKS}, {_STATS}, {_RATED} select doc_id, source_page, min(level) as level, arg_min(reasons, level * 1000000 + page) as reasons from rated group by all")
def e08_source_page_ratings(spark, sf_dir):
    """The lowest rating of each original page."""
    return Q.by_source_page(Q.rate_pages(_stats(spark, sf_dir), _info(spark, sf_dir))).select("doc_id", "source_page", "level", _shown())


_DL, _DR = _level("ow", "us", "ocr * 2 >= greatest(1, pages)", "(fo / greatest(1, n)::double)", "(case when br > 0 then sp / br::double else 0.0 end)", "odd * 2 > greatest(1, pages)")


@query(
    f"""with {BLOCKS}, {_STATS}, {_RATED}, total as (select doc_id, count_if(words > 0) as n, sum(ocr_words) as ow, sum(unsure) as us, sum(formulas) as fo, sum(breaks) as br, sum(split) as sp from stats group by doc_id),
kinds as (select doc_id, count(*) as pages, count_if(ocr) as ocr, count_if(unusual) as odd from info group by doc_id), weak as (select doc_id, count(*) as rated, count_if(level <= 2) as weak from rated group by doc_id),
first as (select doc_id, rated, weak, {_DL} as l, {_DR} as r from total join kinds using (doc_id) join weak using (doc_id))
select doc_id, case when weak > 0 and weak * 10 >= rated and l > 3 then 3 else l end as level, case when weak > 0 and weak * 10 >= rated and l > 3 then 'weak_pages:' || weak else r end as reasons from first"""
)
def e07_document_ratings(spark, sf_dir):
    """Ratings of documents."""
    return Q.rate_documents(_stats(spark, sf_dir), _info(spark, sf_dir)).select("doc_id", "level", _shown())


@query("""with p as (select l_orderkey as doc, case l_linenumber % 3 when 0 then 'mixed' when 1 then 'text' else 'scanned' end as kind from lineitem)
select doc, case when bool_and(kind = 'text') then 'text' when bool_and(kind = 'scanned') then 'scanned' else 'mixed' end as kind from p group by doc""")
def e09_document_kinds(spark, sf_dir):
    """Kinds of documents by their pages' kinds."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("case l_linenumber % 3 when 0 then 'mixed' when 1 then 'text' else 'scanned' end").alias("kind"))
    return Q.document_kind(pages).select(F.col("doc_id").alias("doc"), "kind")


# Cells made from order lines: numbers with one decimal, some without the point, some with a letter for a digit.
_CELLS = """cells as (select l_suppkey as t, l_orderkey // 40 as part, row_number() over (partition by l_suppkey, l_orderkey // 40 order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as r, l_partkey as p, l_linenumber as n from lineitem),
two as (select t, part, r, 0 as c, case when p % 11 = 0 then (p % 90)::varchar || '1' when p % 13 = 0 then 'O.' || (p % 10) else (p % 90)::varchar || '.' || (p % 10) end as x, (p * 7) % 101 as conf from cells
  union all select t, part, r, 1, case when n % 2 = 0 then 'word' || n else (p % 50)::varchar || case when p % 3 = 0 then ',5' else '' end end, -1 from cells)"""


def _cells(spark, sf_dir):
    order = W.partitionBy("l_suppkey", "part").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("part", F.expr("l_orderkey div 40")).withColumn("r", F.row_number().over(order) - 1)
    one = F.expr("case when l_partkey % 11 = 0 then concat(l_partkey % 90, '1') when l_partkey % 13 = 0 then concat('O.', l_partkey % 10) else concat(l_partkey % 90, '.', l_partkey % 10) end")
    two = F.expr("case when l_linenumber % 2 = 0 then concat('word', l_linenumber) else concat(l_partkey % 50, case when l_partkey % 3 = 0 then ',5' else '' end) end")
    cells = F.array(F.struct(F.lit(0).alias("col"), one.alias("text"), F.expr("cast((l_partkey * 7) % 101 as double)").alias("c")), F.struct(F.lit(1).alias("col"), two.alias("text"), F.lit(-1.0).alias("c")))
    rows = rows.select(F.col("l_suppkey").alias("doc_id"), F.col("part").alias("table_id"), F.col("r").alias("row"), F.explode(cells).alias("x"))
    return rows.select("doc_id", "table_id", "row", "x.col", "x.text", F.lit(1).alias("header_rows"), F.col("x.c").alias("min_conf"))


@query(rf"""with {_CELLS}, f as (select *, regexp_full_match(x, '[-−–+]?[0-9]+(?:[.,][0-9]+)?%?') as num, r >= 1 as body, regexp_matches(x, '[.,]') as pt from two),
g as (select *, count_if(body) over (partition by t, part, c) as nb, count_if(body and num) over (partition by t, part, c) as nn, case when body and num and pt then length(regexp_extract(x, '[.,]([0-9]+)', 1)) end as pl,
  count_if(num) over (partition by t, part, r) - num::int as others, count_if(num and pt) over (partition by t, part, r) - (num and pt)::int as pointed from f),
m as (select t, part, c, pl, count(*) as k, min(r) as first from g where pl is not null group by all), d as (select t, part, c, arg_max(pl, k * 1000000 - first) as dec from m group by all),
w as (select g.*, case when conf >= 0 and conf < 50 and x <> '' then 'unclear' when body and nn >= 3 and nn * 2 >= nb and ((not num and regexp_full_match(x, '[-−–+]?[0-9OoIl|.,]+%?') and regexp_matches(x, '[OoIl|]'))
  or (num and not pt and dec is not null and length(regexp_replace(x, '[^0-9]', '', 'g')) > dec and regexp_replace(x, '[^0-9]', '', 'g') <> '0' and not (others > 0 and pointed = 0))) then 'number' end as why from g left join d using (t, part, c))
select t as doc_id, part as table_id, r as row, c as col, x as text, why from w where why is not null""")
def e13_doubtful_cells(spark, sf_dir):
    """Cells to check in made-up tables (confidences: E14)."""
    return T.doubtful_cells(_cells(spark, sf_dir)).withColumn("row", F.col("row").cast("long"))


@query(rf"""with {_CELLS}, s as (select t, part, max(r) + 1 as nr, max(c) + 1 as nc, count_if(x not like 'word%') as filled from two group by all) select t as doc_id, part as table_id, 1 - filled / (nr * nc)::double < 0.35 and nc <= 10 as reliable from s where nr >= 2 and nc >= 2""")
def e21_reliable_tables(spark, sf_dir):
    """Which made-up tables are reliable (cells of words counted as empty)."""
    cells = _cells(spark, sf_dir).withColumn("text", F.when(F.col("text").startswith("word"), "").otherwise(F.col("text")))
    return T.reliable(cells)


@query(rf"""with {_CELLS}, l as (select t, part, r, string_agg(x, chr(9) order by c) as line from two group by all) select t as doc_id, part as table_id, md5(string_agg(line, chr(10) order by r)) as text from l group by all""")
def i25_table_texts(spark, sf_dir):
    """Tables as text."""
    return T.as_text(_cells(spark, sf_dir)).withColumn("text", F.md5("text"))


_ORDERED = """with rn as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, l_partkey, l_suppkey, l_linenumber from lineitem)"""


def _ordered(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("id"), "l_partkey", "l_suppkey", "l_linenumber")


@query(
    _ORDERED
    + """, h as (select doc, id, l_partkey % 100 as s, l_partkey % 100 + l_suppkey % 30 as e, case when l_linenumber % 2 = 0 then 'n' || id else '' end as note from rn),
parts as (select doc, id, s, least(e, 39) as e, note, 0 as side from h where s < 40 union all select doc, id, greatest(s, 61), e, case when s < 40 then '' else note end, 1 from h where e > 60)
select doc as doc_id, id, s as start, e as "end", note from parts"""
)
def l10_erased_highlights(spark, sf_dir):
    """Made-up highlights after words 40 to 60 were erased."""
    rows = _ordered(spark, sf_dir).select("doc_id", "id", F.expr("l_partkey % 100").alias("start"), F.expr("l_partkey % 100 + l_suppkey % 30").alias("end"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise("").alias("note"))
    return H.erase(rows, 60, 40).select("doc_id", "id", "start", "end", "note")


@query(r"""with w as (select doc_id, unnest(x) as text, unnest(generate_series(0, len(x) - 1)) as n from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as x from documents)),
z as (select *, lag(text) over o as before, lead(text) over o as second from w window o as (partition by doc_id order by n)),
h as (select doc_id, n as id, n + doc_id % 7 as start, text || ' ' || second as words from z where second is not null and regexp_matches(coalesce(before, '.'), '[.!?]$')),
c as (select h.doc_id, h.id, h.start, z.n as place from h join z on z.doc_id = h.doc_id and z.text || ' ' || z.second = h.words and abs(z.n - h.start) <= 400)
select doc_id, id, start, arg_min(place, abs(place - start) * 1000000 + place) as "at" from c group by all""")
def d10_highlights_found_again(spark, sf_dir):
    """Highlights of every sentence's first two words, stored some words off, found again."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    order = W.partitionBy("doc_id").orderBy("n")
    marks = words.select("doc_id", "n", "text", F.lag("text", 1, ".").over(order).alias("before"), F.lead("text").over(order).alias("second")).where("second is not null").where(F.col("before").rlike("[.!?]$"))
    marks = marks.select("doc_id", F.col("n").alias("id"), (F.col("n") + F.col("doc_id") % 7).alias("start"), F.concat_ws(" ", "text", "second").alias("words"))
    return H.resolve(marks, words).select("doc_id", "id", "start", "at")


@query(
    _ORDERED
    + """, h as (select doc, l_partkey as n, case l_suppkey % 2 when 0 then 'yellow' else 'green' end as colour, case when l_linenumber > 3 then 'x' else ' ' end as note from rn), d as (select doc, min(l_partkey) + 20 as n, 'H' || doc as heading from rn group by doc),
u as (select h.*, case when h.n >= d.n then d.heading else '' end as heading from h join d using (doc)) select doc as doc_id, heading, colour, count(*) as marks, count_if(trim(note) <> '') as notes from u group by all"""
)
def b13_study_sheet(spark, sf_dir):
    """Highlights counted by colour under their headings."""
    rows = _ordered(spark, sf_dir)
    marks = rows.select("doc_id", F.col("l_partkey").alias("start"), F.when(F.col("l_suppkey") % 2 == 0, "yellow").otherwise("green").alias("colour"), F.when(F.col("l_linenumber") > 3, "x").otherwise(" ").alias("note"))
    heads = rows.groupBy("doc_id").agg((F.min("l_partkey") + 20).alias("n")).withColumn("heading", F.concat(F.lit("H"), F.col("doc_id").cast("string")))
    return H.study_sheet(marks, heads)


@query(
    _ORDERED
    + """, w as (select doc, id as n, l_partkey * 1.0 as x0, l_partkey + 20.0 as x1, 100.0 * (id % 4) as y0, 100.0 * (id % 4) + 10 as y1 from rn), p as (select doc, id, l_suppkey * 17.0 as x, 90.0 * l_linenumber as y from rn)
select p.doc as doc_id, p.id, arg_min(n, [greatest(x0 - x, 0, x - x1) ** 2 + (3 * greatest(y0 - y, 0, y - y1)) ** 2, n]) as word from p join w on w.doc = p.doc group by all"""
)
def d12_nearest_words(spark, sf_dir):
    """The word nearest to made-up points."""
    rows = _ordered(spark, sf_dir).withColumn("page", F.lit(1))
    y = (F.col("id") % 4) * 100.0
    words = rows.select("doc_id", "page", F.col("id").alias("n"), F.col("l_partkey").cast("double").alias("x0"), (F.col("l_partkey") + 20.0).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    points = rows.select("doc_id", "page", "id", (F.col("l_suppkey") * 17.0).alias("x"), (F.col("l_linenumber") * 90.0).alias("y"))
    return H.nearest_word(points, words).select("doc_id", "id", "word")


@query("""with s as (select event_id as id, event_type || ' ' || (user_id % 40) as snippet from events), c as (select distinct sha256(event_type || ' ' || (user_id % 40)) as key from events where user_id % 40 < 3),
k as (select sha256(snippet) as key, snippet, list_sort(list(id)) as ids from s where sha256(snippet) not in (select key from c) group by all) select key, snippet, ids, ((row_number() over (order by key) - 1) // 30)::bigint as request from k""")
def m01_planned_requests(spark, sf_dir):
    """Snippets without a cached answer, each once (H05), thirty to a request."""
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.expr("cast(user_id % 40 as string)")).alias("snippet"))
    cache = items.where("cast(substring_index(snippet, ' ', -1) as int) < 3").select(X.cache_key(F.col("snippet")).alias("key"))
    return R.plan(items, cache)


@query("""with v as (select o_orderkey, 'recieve' as original, 'receive' as replacement, 0.6 as confidence, 'dictionary' as source, o_orderkey % 5 > 0 as wrong, (['', 'receive', 'relieve', 'two words', 'entirely'])[o_orderkey % 5 + 1] as word from orders),
a as (select *, case when not wrong then 1 when word = '' or contains(word, ' ') or levenshtein(lower(word), lower(original)) > greatest(2, length(original) // 3) then 2 when word = replacement then 3 else 4 end as k from v)
select o_orderkey, case when k = 4 then word else replacement end as replacement, case k when 1 then least(confidence, 0.3) when 2 then confidence when 3 then greatest(confidence, 0.9) else 0.8 end::double as confidence,
  case k when 1 then 'dictionary; AI: probably not an error' when 2 then source when 3 then 'dictionary; AI agrees' else 'ai' end as source from a""")
def m04_verdicts(spark, sf_dir):
    """Fixes after made-up answers."""
    word = F.element_at(F.array(*map(F.lit, ("", "receive", "relieve", "two words", "entirely"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    done = R.verdict(F.lit("recieve"), F.lit("receive"), F.lit(0.6), F.lit("dictionary"), F.col("o_orderkey") % 5 > 0, word)
    return table(spark, sf_dir, "orders").select("o_orderkey", done.alias("v")).select("o_orderkey", "v.replacement", "v.confidence", "v.source")


@query("""with a as (select l_orderkey as page, list((l_partkey % 6)::int order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o, 5 as k from lineitem group by 1)
select page, case when len(list_filter(o, lambda i: i >= k)) = 0 and len(list_distinct(o)) = len(o) then list_concat(o, list_filter([0, 1, 2, 3, 4], lambda i: not list_contains(o, i))) end as "order" from a""")
def l05_checked_orders(spark, sf_dir):
    """Reading orders that keep every piece once."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr("cast(l_partkey % 6 as int)").alias("o"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return rows.select("page", R.checked_order(F.transform("x", lambda v: v["o"]), F.lit(5)).alias("order"))


@query("""select event_type as task, count(*) as requests, sum(user_id)::bigint as items, sum(event_id)::bigint as input_tokens, sum(event_id % 7)::bigint as output_tokens from events group by rollup(event_type)""")
def e17_token_usage(spark, sf_dir):
    """Requests and tokens by task, with a total."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("items"), F.col("event_id").alias("input_tokens"), F.expr("event_id % 7").alias("output_tokens"))
    return R.usage(log)


@query("select event_id, ts, event_type from events order by ts desc, event_id, event_type limit 500")
def g03_newest_requests(spark, sf_dir):
    """The 500 newest entries of a log."""
    return R.newest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", 500)


@query("""with k as (select l_orderkey as doc_id, l_linenumber as seq, (['heading', 'title', 'paragraph', 'table', 'quote', 'caption', 'footnote'])[l_linenumber::int] as kind, (l_suppkey % 5)::int as level, case when l_partkey % 2 = 0 then 'ocr' else 'text' end as source, l_partkey, l_suppkey, l_extendedprice from lineitem)
select doc_id, seq, l_partkey, l_suppkey, l_extendedprice, (case kind when 'heading' then 'H' || least(3, greatest(1, level)) when 'title' then 'T' when 'paragraph' then 'P' when 'quote' then 'Q' when 'caption' then 'C' when 'footnote' then 'N' end) || case when source = 'ocr' then ' scan' else '' end as code from k""")
def c19_block_codes(spark, sf_dir):
    """How a check names blocks."""
    kind = F.element_at(F.array(*map(F.lit, ("heading", "title", "paragraph", "table", "quote", "caption", "footnote"))), F.col("l_linenumber").cast("int"))
    rows = table(spark, sf_dir, "lineitem")
    code = R.block_code(kind, F.expr("cast(l_suppkey % 5 as int)"), F.when(F.col("l_partkey") % 2 == 0, "ocr").otherwise("text"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), "l_partkey", "l_suppkey", "l_extendedprice", code.alias("code"))


@query("""with a as (select l_orderkey as doc, l_linenumber * 1000 + l_suppkey as seq, 't' || (l_partkey % 3) as text, 'o' || l_linenumber || '-' || l_suppkey || '-' || l_partkey as id from lineitem where l_returnflag = 'N'),
b as (select l_orderkey as doc, l_suppkey * 1000 + l_linenumber as seq, 't' || (l_partkey % 3) as text, 'n' || l_linenumber || '-' || l_suppkey || '-' || l_partkey as id from lineitem where l_linenumber < 6),
x as (select *, row_number() over (partition by doc, text order by seq, id) as k from a), y as (select *, row_number() over (partition by doc, text order by seq, id) as k from b)
select x.doc as doc_id, x.id as old_id, y.id as new_id from x join y on x.doc = y.doc and x.text = y.text and x.k = y.k""")
def d13_blocks_before_and_after(spark, sf_dir):
    """The k-th copy of a text in an old and a new version of a document."""
    rows = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("t"), F.expr("cast(l_partkey % 3 as string)"))
    name = lambda p: F.concat(F.lit(p), F.concat_ws("-", "l_linenumber", "l_suppkey", "l_partkey"))
    old = rows.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("doc_id"), F.struct(F.expr("l_linenumber * 1000 + l_suppkey").alias("s"), name("o").alias("i")).alias("seq"), text.alias("text"), name("o").alias("block_id"))
    new = rows.where("l_linenumber < 6").select(F.col("l_orderkey").alias("doc_id"), F.struct(F.expr("l_suppkey * 1000 + l_linenumber").alias("s"), name("n").alias("i")).alias("seq"), text.alias("text"), name("n").alias("block_id"))
    return L.map_equal_blocks(old, new)


@query("""with f as (select distinct l_orderkey as block, (l_partkey % 50)::int as start, l_suppkey % 3 as put from lineitem where l_linenumber < 4), e as (select l_orderkey as block, (l_partkey % 50)::int as start, l_suppkey % 3 as put, min(case l_linenumber % 2 when 0 then 'accepted' else 'rejected' end) as s from lineitem group by all)
select f.block, f.start, f.put, coalesce(e.s, 'pending') as status from f left join e using (block, start, put)""")
def d14_decisions_kept(spark, sf_dir):
    """New corrections with what was decided about the same ones before."""
    rows = table(spark, sf_dir, "lineitem").withColumn("start", F.expr("cast(l_partkey % 50 as int)")).withColumn("put", F.expr("l_suppkey % 3"))
    fresh = rows.where("l_linenumber < 4").select(F.col("l_orderkey").alias("block"), "start", "put").distinct().withColumn("status", F.lit("pending"))
    earlier = rows.groupBy(F.col("l_orderkey").alias("block"), "start", "put").agg(F.min(F.when(F.col("l_linenumber") % 2 == 0, "accepted").otherwise("rejected")).alias("status"))
    return L.carry_decisions(fresh, earlier, ["block", "start", "put"])
