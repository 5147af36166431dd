"""Queries of lines, breaks, styles, timing and stores, over inputs made from order lines, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import overlay as O
from ..functions import timing
from ..operators import lines as L
from ..operators import stores as K
from ..operators.blocks import table
from .registry import query

_RN = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_BASE = f"base as (select l_orderkey as doc_id, {_RN} as seq, l_partkey as p, l_suppkey as s, l_linenumber as n, l_quantity as q from lineitem)"


def _base(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q")
    )


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({number} + 1 as int)"))


def _listed(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SAID = ("plain words go on", "Another sentence stops.", "third of the lines")


@query(f"""with {_BASE}, ln as (select doc_id, (seq - 1) // 3 as para, seq, n as page, ({_listed(_SAID)})[p % 3 + 1] as text, 9 + (s % 3) as size, p % 2 = 0 as bold, 40.0 + p % 5 as x0, 200.0 + s % 9 as x1, 100.0 + seq * 12 as y0, 110.0 + seq * 12 as y1 from base),
z as (select doc_id, para, size, sum(length(text)) as chars, min(seq) as first from ln group by all), best as (select doc_id, para, arg_max(size, chars * 100 - first) as size from z group by all)
select doc_id, para, string_agg(text, ' ' order by seq) as text, any_value(b.size)::double as size, sum(case when bold then length(text) else 0 end) > 0.6 * sum(length(text)) as bold, min(x0)::double as x0, min(y0)::double as y0, max(x1)::double as x1, max(y1)::double as y1, arg_min(page, seq) as page, count(*) as n_lines
from ln join best b using (doc_id, para) group by all""")
def f29_paragraph_stats(spark, sf_dir):
    """Lines gathered into paragraphs, with their size, boldness and box."""
    rows = _base(spark, sf_dir).select(
        "doc_id", F.expr("(seq - 1) div 3").alias("para"), "seq", F.col("n").alias("page"), _pick(_SAID, "p % 3").alias("text"), F.expr("9.0D + s % 3").alias("size"), (F.col("p") % 2 == 0).alias("bold"),
        F.expr("40.0D + p % 5").alias("x0"), F.expr("200.0D + s % 9").alias("x1"), F.expr("100.0D + seq * 12").alias("y0"), F.expr("110.0D + seq * 12").alias("y1"),
    )
    return L.paragraph_stats(rows)


_LOW = ("1 A note here", "[3] An entry", "Fig. 2. A caption", "plain words at the foot", "References", "words of the page that go on", "and words again")
_PLACED = f"""ln as (select doc_id, (seq - 1) // 4 as page, seq, ({_listed(_LOW)})[s % 7 + 1] as text, case when p % 3 = 0 then 10.0 when p % 3 = 1 then 8.0 else 9.0 end as size, 50.0 + (p % 2) * 10 as x0, 400.0 as x1, 330.0 + ((seq - 1) % 4) * (100 + p % 2) as y0, 340.0 + ((seq - 1) % 4) * (100 + p % 2) as y1, n % 3 = 0 as raised, 700.0 as height from base)"""


@query(rf"""with {_BASE}, {_PLACED}, r as (select *, size < 10 * {L.NOTE_SIZE} as small from ln),
w as (select doc_id, page, min(x0) as lft, max(x1) as rgt from r where length(trim(text)) > 3 group by all),
low as (select r.* from r join w using (doc_id, page) where small and y0 > height * {L.NOTE_FROM} and x1 > lft - 5 and x0 < rgt + 5),
normal as (select * from r where not small and length(text) > 3),
zone as (select * from low l where exists (select 1 from normal o where o.doc_id = l.doc_id and o.page = l.page) and not exists (select 1 from normal o where o.doc_id = l.doc_id and o.page = l.page and o.y0 > l.y0 + 1 and least(o.x1, l.x1) - greatest(o.x0, l.x0) > 5)
  and not exists (select 1 from r o where o.doc_id = l.doc_id and o.page = l.page and o.text = 'References' and o.y1 <= l.y0 and least(o.x1 + 200, l.x1) - greatest(o.x0, l.x0) > 0)),
f as (select *, coalesce(min(y0) over (partition by doc_id, page order by y1 desc, seq desc rows between unbounded preceding and 1 preceding) - y1 >= {L.NOTE_GAP} * greatest(y1 - y0, 1.0), false)::int as far from zone),
kept as (select * from (select *, sum(far) over (partition by doc_id, page order by y1 desc, seq desc) as breaks from f) where breaks = 0),
b as (select doc_id, page, max(y1) as bottom, min(size) as least_, bool_or(raised or regexp_matches(text, '{L.NOTE_START}')) as marked, arg_min(text, y0 * 1000 + seq) as first, count(*) filter (starts_with(text, '[')) as nb from kept group by all)
select k.doc_id, k.page, k.seq from kept k join b using (doc_id, page) where (marked or least_ < 10 * {L.NOTE_SURE}) and not starts_with(first, 'Fig.') and not starts_with(first, '[') and nb < 2
  and not exists (select 1 from r o where o.doc_id = k.doc_id and o.page = k.page and o.y0 > bottom and least(o.x1, k.x1) - greatest(o.x0, k.x0) > 5)""")
def f10_footnote_lines(spark, sf_dir):
    """The lines of notes at the foot of made-up pages."""
    size = F.when(F.col("p") % 3 == 0, 10.0).when(F.col("p") % 3 == 1, 8.0).otherwise(9.0)
    y = F.expr("330.0D + ((seq - 1) % 4) * (100 + p % 2)")
    rows = _base(spark, sf_dir).select(
        "doc_id", F.expr("(seq - 1) div 4").alias("page"), "seq", _pick(_LOW, "s % 7").alias("text"), size.alias("size"), F.expr("50.0D + (p % 2) * 10").alias("x0"), F.lit(400.0).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), (F.col("n") % 3 == 0).alias("raised"), F.lit(700.0).alias("height"),
    )
    body = rows.select("doc_id").distinct().withColumn("body", F.lit(10.0))
    return L.footnote_lines(rows, body)


_KINDS = ("paragraph", "paragraph", "image", "paragraph", "footnote", "heading", "paragraph", "caption")
_TEXTS = ("goes on and on in small", "Begins with a capital and", "ends with a stop.", "a word cut by a hy-", "phen in the next", "12 of them were", "results")
_BROKEN = f"""bl as (select doc_id, seq, ({_listed(_KINDS)})[p % 8 + 1] as kind, ({_listed(_TEXTS)})[s % 7 + 1] as text, case when n % 5 = 0 then 12.0 else 10.0 end as size from base)"""


@query(rf"""with {_BASE}, {_BROKEN}, r as (select *, kind not in ('image', 'table', 'caption', 'furniture', 'footnote') as running from bl),
b as (select *, last_value(case when running then kind end ignore nulls) over w as bk, last_value(case when running then text end ignore nulls) over w as bt, last_value(case when running then size end ignore nulls) over w as bs,
  sum(case when kind in ('image', 'table', 'caption') then 1 else 0 end) over (partition by doc_id order by seq) as fl from r window w as (partition by doc_id order by seq rows between unbounded preceding and 1 preceding)),
c as (select *, last_value(case when running then fl end ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as bfl from b),
g as (select *, running and coalesce(kind = 'paragraph' and bk = 'paragraph' and abs(size - bs) <= 1 and not ends_with(bt, '.') and case when fl > bfl then regexp_matches(text, '^\p{{Ll}}') else not regexp_matches(text, '^\p{{Lu}}') end and text <> 'results' and bt <> 'results', false) as goes from c),
pa as (select *, case when goes then last_value(case when running and not goes then seq end ignore nulls) over (partition by doc_id order by seq) else seq end as para from g),
j as (select *, lag(text) over (partition by doc_id, para order by seq) as pt, row_number() over (partition by doc_id, para order by seq) as k from pa),
h as (select *, coalesce(ends_with(pt, ' hy-') and starts_with(text, 'phen'), false) as closed from j),
x as (select *, coalesce(lead(closed) over (partition by doc_id, para order by seq), false) as cut from h)
select doc_id, para as seq, arg_min(kind, seq) as kind, string_agg(case when k = 1 or closed then '' else ' ' end || case when cut then left(text, length(text) - 1) else text end, '' order by x.seq) as text, arg_min(size, x.seq)::double as size, count(*) as n_parts from x group by doc_id, para""")
def f08_paragraphs_across_breaks(spark, sf_dir):
    """Made-up blocks with those that go on after a break put together."""
    rows = _base(spark, sf_dir).select("doc_id", "seq", _pick(_KINDS, "p % 8").alias("kind"), _pick(_TEXTS, "s % 7").alias("text"), F.when(F.col("n") % 5 == 0, 12.0).otherwise(10.0).alias("size"))
    known = spark.range(1).select(F.lit("hyphen").alias("word"))
    return L.merged(rows, known)


_SPANS = ("•", "some words", "and more", "of a line")


@query(f"""with {_BASE}, sp as (select doc_id, (seq - 1) // 6 as page, seq, ({_listed(_SPANS)})[s % 4 + 1] as text, 50.0 + p % 400 as x0, 60.0 + p % 400 + q as x1, 100.0 + (n % 3) * 4 as base, 10.0 as size from base),
a as (select *, coalesce(base - lag(base) over w > 0.25 * size, true)::int as step from sp window w as (partition by doc_id, page order by base, x0, seq)), b as (select *, sum(step) over (partition by doc_id, page order by base, x0, seq) as row_ from a),
c as (select *, coalesce(lag(row_) over w <> row_ or (x0 - lag(x1) over w > 1.6 * size and lag(text) over w <> '•'), true)::int as new from b window w as (partition by doc_id, page order by row_, x0, seq)),
d as (select *, sum(new) over (partition by doc_id, page order by row_, x0, seq) as line from c)
select doc_id, page, line::bigint as line, string_agg(text, ' ' order by x0, seq) as text, min(x0)::double as x0, max(x1)::double as x1, max(size)::double as size from d group by all""")
def a11_joined_fragments(spark, sf_dir):
    """Made-up spans of one baseline joined to lines."""
    rows = _base(spark, sf_dir).select("doc_id", F.expr("(seq - 1) div 6").alias("page"), "seq", _pick(_SPANS, "s % 4").alias("text"), F.expr("50.0D + p % 400").alias("x0"), F.expr("60.0D + p % 400 + q").alias("x1"), F.expr("100.0D + (n % 3) * 4").alias("base"), F.lit(10.0).alias("size"))
    return L.joined_fragments(rows)


@query("""with o as (select o_orderkey as doc_id, o_orderkey % 9 as cut, unnest(generate_series(0, 3)) as line, o_custkey as c from orders), w as (select doc_id, line, cut, c, unnest(generate_series(1, 9)) as n from o),
g as (select doc_id, 0 as page, line, n, n * 30.0 + case when n > cut + (c + line) % 2 then 100 else 0 end as x0, n * 30.0 + 20 + case when n > cut + (c + line) % 2 then 100 else 0 end as x1, 10.0 as height from w),
z as (select *, lead(x0) over (partition by doc_id, line order by n) as nx, 9 as words from g), wide as (select * from z where nx - x1 > 6 * height)
select distinct a.doc_id, a.page, a.line, a.n from wide a join wide b on a.doc_id = b.doc_id and abs(a.line - b.line) = 1 and a.x1 < b.nx and b.x1 < a.nx where a.n >= 2 and 9 - a.n >= 2 and (a.n >= 5 or 9 - a.n >= 5)""")
def a16_gutter_cuts(spark, sf_dir):
    """Where made-up recognised lines are cut at a column gap."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 9).alias("cut"), F.col("o_custkey").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("line"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))))
    x = F.expr("n * 30.0D + case when n > cut + (c + line) % 2 then 100 else 0 end")
    return L.gutter_cuts(rows.select("doc_id", F.lit(0).alias("page"), "line", "n", x.alias("x0"), (x + 20).alias("x1"), F.lit(10.0).alias("height")))


@query(f"""with {_BASE}, it as (select doc_id, 0 as page, (seq - 1) // 3 as piece, seq, 30.0 + p % 50 as x0, 40.0 + seq * 20 as y0, 200.0 + s % 70 as x1, 50.0 + seq * 20 as y1, 8.0 + p % 4 as size, case when s % 3 > 0 then 'line ' || n end as text from base),
z as (select *, list(size) over (partition by doc_id, piece) as sizes from it)
select doc_id, page, piece, round(100 * min(x0) / 500.0, 2)::double as x, round(100 * min(y0) / 800.0, 2)::double as y, round(100 * (max(x1) - min(x0)) / 500.0, 2)::double as width, round(100 * (max(y1) - min(y0)) / 800.0, 2)::double as height,
  (list_sort(list(size)))[len(list(size)) // 2 + 1]::double as size, string_agg(text, ' ' order by seq) as text from it group by doc_id, page, piece""")
def a43_piece_view(spark, sf_dir):
    """Made-up pieces of a page in hundredths of it."""
    rows = _base(spark, sf_dir).select(
        "doc_id", F.lit(0).alias("page"), F.expr("(seq - 1) div 3").alias("piece"), "seq", F.expr("30.0D + p % 50").alias("x0"), F.expr("40.0D + seq * 20").alias("y0"), F.expr("200.0D + s % 70").alias("x1"), F.expr("50.0D + seq * 20").alias("y1"),
        F.expr("8.0D + p % 4").alias("size"), F.when(F.col("s") % 3 > 0, F.concat(F.lit("line "), F.col("n").cast("string"))).alias("text"), F.lit(500.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )
    return L.piece_view(rows)


@query(r"""with b as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seq from documents)
select doc_id, seq::int as seq, 0 as math, len(regexp_extract_all(text, '[=+\-−×÷·∑∏∫√≤≥≠≈∞∂∇∈⊂∪∩^_{}|<>/]|\p{Greek}|[0-9]'))::int as "like", len(regexp_extract_all(text, '\S'))::int as chars, len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: length(w) >= 4))::int as words from b""")
def c09_math_profiles(spark, sf_dir):
    """What the lines of the documents are made of."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return rows.select("doc_id", "seq", L.math_profile(F.col("text"), F.lit(0)).alias("m")).select("doc_id", "seq", "m.math", "m.like", "m.chars", "m.words")


_FLAGS = ("superscript", "math", "bold")


def _styles(spark, sf_dir):
    kind = F.col("n") % 3
    style = F.struct(F.expr("cast(p % 18 as int)").alias("start"), F.expr("cast(p % 18 + 1 + s % 6 as int)").alias("end"), (kind == 0).alias("superscript"), (kind == 1).alias("math"), (kind == 2).alias("bold"))
    return _base(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", style.alias("st")))).alias("x")).select("doc_id", F.transform("x", lambda v: v["st"]).alias("styles"))


_STYLES = f"""{_BASE}, st as (select doc_id, seq, (p % 18)::int as a, (p % 18 + 1 + s % 6)::int as z, n % 3 as k from base)"""


@query(f"""with {_STYLES} select doc_id, a as "start", z as "end", count(*) as times from st where k = 0 and z <= 20 and not exists (select 1 from st m where m.doc_id = st.doc_id and m.k = 1 and m.a <= st.a and st.z <= m.z) group by all""")
def c21_raised_ranges(spark, sf_dir):
    """Raised ranges outside formulas, of a text of 20 characters."""
    rows = _styles(spark, sf_dir).select("doc_id", F.explode(O.raised_ranges(F.col("styles"), F.lit(20))).alias("r"))
    return rows.groupBy("doc_id", "r.start", "r.end").agg(F.count("*").alias("times"))


@query(f"""with {_STYLES}, r as (select doc_id, seq, k, a, z, (doc_id % 12)::int as f, (doc_id % 12 + doc_id % 5)::int as t, repeat('z', (doc_id % 4)::int) as put from st),
m as (select *, length(put) - (t - f) as d, case when a <= f then a when a < t then f + length(put) else a + length(put) - (t - f) end as na, case when z <= f then z when z < t then f + length(put) else z + length(put) - (t - f) end as nz from r)
select doc_id, substr('abcdefghijklmnopqrstuvwxy', 1, f) || put || substr('abcdefghijklmnopqrstuvwxy', t + 1) as text, k = 2 as bold, na::int as "start", nz::int as "end", count(*) as times from m where nz > na group by all""")
def a42_replaced_runs(spark, sf_dir):
    """Styles that move along when a run of a text is replaced."""
    start, end = F.expr("cast(doc_id % 12 as int)"), F.expr("cast(doc_id % 12 + doc_id % 5 as int)")
    made = O.replace_run(F.lit("abcdefghijklmnopqrstuvwxy"), F.col("styles"), start, end, F.expr("repeat('z', cast(doc_id % 4 as int))"))
    rows = _styles(spark, sf_dir).select("doc_id", made.alias("m")).select("doc_id", "m.text", F.explode("m.styles").alias("r"))
    return rows.groupBy("doc_id", "text", "r.bold", "r.start", "r.end").agg(F.count("*").alias("times"))


_SOUNDS = ("ha ˈlo:", "e nd. a", "tu", "sa, ri mo!", "ke ke")
_WORDS = ("one", "two,", "three.", "four")


@query(rf"""with {_BASE}, parts as (select doc_id, seq as part, q / 10 as seconds, ({_listed(_SOUNDS)})[p % 5 + 1] as sounds from base), words as (select doc_id, unnest(generate_series(0, (doc_id % 13 + 1)::int)) as n, from (select distinct doc_id from base)),
wt as (select doc_id, n, ({_listed(_WORDS)})[(doc_id + n) % 4 + 1] as text from words), t0 as (select *, coalesce(sum(seconds) over (partition by doc_id order by part rows between unbounded preceding and 1 preceding), 0) as t0 from parts),
sp as (select doc_id, part, seconds, t0, unnest(string_split(sounds, ' ')) as x, generate_subscripts(string_split(sounds, ' '), 1) as k from t0),
we as (select *, len(regexp_extract_all(x, '[^\s,;:.!?ˈˌː]')) + 3 * len(regexp_extract_all(x, '[,;:]')) + 5 * len(regexp_extract_all(x, '[.!?]')) as weight from sp),
sd as (select doc_id, t0 + seconds * coalesce(sum(weight) over (partition by doc_id, part order by k rows between unbounded preceding and 1 preceding), 0) / sum(weight) over (partition by doc_id, part) as start, row_number() over (partition by doc_id order by part, k) - 1 as n from we where weight > 0),
lw as (select *, length(text) + case when regexp_matches(text, '[,;:]$') then 3 when regexp_matches(text, '[.!?]$') then 5 else 1 end as w from wt),
bl as (select *, coalesce(sum(w) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) / sum(w) over (partition by doc_id) as share, count(*) over (partition by doc_id) as written from lw),
c as (select doc_id, count(*) as spoken from sd group by all), wh as (select doc_id, sum(seconds) as whole from parts group by all)
select b.doc_id, b.n, case when spoken = written then sd.start else whole * share end::double as start from bl b join c using (doc_id) join wh using (doc_id) left join sd on sd.doc_id = b.doc_id and sd.n = b.n""")
def f24_word_times(spark, sf_dir):
    """When the words of made-up texts begin."""
    rows = _base(spark, sf_dir)
    parts = rows.select("doc_id", F.col("seq").alias("part"), (F.col("q") / 10).alias("seconds"), _pick(_SOUNDS, "p % 5").alias("sounds"))
    words = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 13 + 1)).alias("n"))
    return timing.word_times(words.select("doc_id", "n", _pick(_WORDS, "(doc_id + n) % 4").alias("text")), parts)


@query("""with asked as (select distinct sha256(event_type || chr(31) || (user_id % 50)::varchar) as key from events), store as (select sha256('click' || chr(31) || i::varchar) as key, 'old' as value from range(60) t(i)),
new as (select key, 'new' as value from asked where key not in (select key from store) union all select sha256('click' || chr(31) || '3'), 'again')
select key, value from store where key not in (select key from new) union all select key, value from new""")
def m05_answer_store(spark, sf_dir):
    """A store of answers after those that were missing were put into it, and one anew."""
    key = lambda kind, n: K.answer_key(kind, n.cast("string"))
    asked = table(spark, sf_dir, "events").select(key(F.col("event_type"), F.col("user_id") % 50).alias("key"))
    store = spark.range(60).select(key(F.lit("click"), F.col("id")).alias("key"), F.lit("old").alias("value"))
    again = spark.range(1).select(key(F.lit("click"), F.lit(3)).alias("key"), F.lit("again").alias("value"))
    return K.put(store, K.missing(asked, store).select("key", F.lit("new").alias("value")).unionByName(again))


@query(r"""with l as (select event_id as n, event_type as task, 'm' || user_id % 3 as model, (user_id % 7)::int as items, case when event_id % 4 = 0 then '' else 'said ' || event_id end as answer from events where event_id % 9 <> 5),
k as (select * from l order by n desc limit 500)
select n, '=== local / ' || model || '  task: ' || task || '  items: ' || items || chr(10) || 'tokens in: ' || (n * 2) || '  tokens out: ' || n || chr(10) || '--- sent' || chr(10) || 'p' || n || chr(10) || '--- received' || chr(10) || case when answer <> '' then answer else 'none' end as text from k""")
def m06_request_log(spark, sf_dir):
    """The newest 500 entries of a log with damaged lines, as the reader is shown them."""
    n = F.col("event_id").cast("string")
    answer = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("said "), n))
    entry = F.to_json(F.struct(
        F.col("event_type").alias("task"), F.lit("local").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), (F.col("user_id") % 7).alias("items"), F.concat(F.lit("p"), n).alias("prompt"),
        answer.alias("answer"), F.lit("none").alias("error"), (F.col("event_id") * 2).alias("input_tokens"), F.col("event_id").alias("output_tokens"),
    ))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 9 == 5, F.expr("left('{\"task\": broken', 12)")).otherwise(entry).alias("value"))
    return K.log_text(K.log_entries(lines))


@query("""with k as (select doc_id, sha256(sha256(coalesce(text, '')) || chr(31) || '1.0' || chr(31) || lang) as key from documents), best as (select key, max(doc_id) as newest from k group by key order by newest desc limit 30) select key, newest from best""")
def b14_raw_store(spark, sf_dir):
    """Keys of the 30 documents that were read last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(K.raw_key(text.cast("binary"), F.lit("1.0"), F.col("lang")).alias("key"), "doc_id")
    return K.newest(rows.groupBy("key").agg(F.max("doc_id").alias("newest")), K.RAW_KEPT, F.col("newest").desc())


@query("""with b as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as seq from documents),
k as (select doc_id, seq, text, case when seq % 3 = 2 and doc_id % 2 = 0 then 0 when seq = 1 and doc_id % 3 = 0 then 1 end as rank from b)
select d.doc_id, coalesce(case when d.doc_id % 4 > 0 then d.lang end, 'en') as lang, t.title from documents d left join (select doc_id, arg_min(text, rank * 1000000 + seq) as title from k where rank is not null group by doc_id) t using (doc_id)""")
def l13_session_defaults(spark, sf_dir):
    """Each document's language and title, as a session begins with."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("seq", F.col("seq") + 1)
    kind = F.when((F.col("seq") % 3 == 2) & (F.col("doc_id") % 2 == 0), "title").when((F.col("seq") == 1) & (F.col("doc_id") % 3 == 0), "heading").otherwise("paragraph")
    detected = docs.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("lang"))
    return K.session_defaults(rows.withColumn("kind", kind), detected)


