"""Further queries: marks, regions, markers, candidates, labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import overlay as O
from ..functions import packing as P
from ..functions import text as X
from ..functions.citations import numbers
from ..operators import compose as C
from ..operators import links as L
from ..operators import requests as R
from ..operators import spelling as Sp
from ..operators import structure as S
from ..operators.blocks import lines, table
from .registry import BLOCKS, query

_RN = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def _rows(spark, sf_dir):
    # named before the window, so that what goes on by doc_id finds the rows dealt out by it
    named = {"l_orderkey": "doc_id", "l_partkey": "p", "l_suppkey": "s", "l_linenumber": "n", "l_extendedprice": "price"}
    rows = table(spark, sf_dir, "lineitem").select(*(F.col(c).alias(k) for c, k in named.items()))
    order = W.partitionBy("doc_id").orderBy("n", "p", "s", "price")
    return rows.select("doc_id", F.row_number().over(order).cast("long").alias("seq"), "p", "s", "n")


_BASE = f"base as (select l_orderkey as doc_id, {_RN} as seq, l_partkey as p, l_suppkey as s, l_linenumber as n from lineitem)"


@query(rf"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as x from documents), z as (select doc_id, list_transform(x, lambda w: {{'used': length(w)::int, 'line': 0, 'out': [0]}}) as x from w where len(x) > 0),
d as (select doc_id, list_reduce(x, lambda acc, y: {{'used': case when acc.used + 1 + y.used > 60 then y.used else acc.used + 1 + y.used end, 'line': case when acc.used + 1 + y.used > 60 then acc.line + 1 else acc.line end, 'out': list_append(acc.out, case when acc.used + 1 + y.used > 60 then acc.line + 1 else acc.line end)}}).out as o from z)
select doc_id, o[-1] + 1 as n_lines, md5(array_to_string(o, ',')) as breaks from d""")
def b07_line_breaks(spark, sf_dir):
    """Documents broken into lines of 60 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", P.lines(F.transform(X.words(F.col("text")), lambda w: F.length(w)), 60).alias("o")).where(F.size("o") > 0)
    return rows.select("doc_id", (F.try_element_at("o", F.lit(-1)) + 1).alias("n_lines"), F.md5(F.array_join(F.transform("o", lambda v: v.cast("string")), ",")).alias("breaks"))


@query(f"""with {_BASE}, l as (select doc_id, seq, case n when 1 then 'Contents lists available at X' when 2 then 'Letters of Testing' when 3 then 'journal homepage: www.x' when 4 then 'Research Policy ' || (p % 50 + 1) || ' (2013) 15–20' else 'text' end as text, 10.0 + s * 18 as y0, 20.0 + s * 18 as y1 from base),
t as (select * from l where y1 < 200), f as (select doc_id, arg_min(y0, seq) filter (text like 'Contents%') as a, arg_min(y1, seq) filter (text like 'journal%') as z from t group by doc_id)
select doc_id, seq, text from t join f using (doc_id) where text like 'Contents%' or text like 'journal%' or (text like 'Research Policy%' and y1 < 96) or (y0 >= a and y1 <= z)""")
def c06_mastheads(spark, sf_dir):
    """Mastheads of made-up first pages."""
    text = F.expr("case n when 1 then 'Contents lists available at X' when 2 then 'Letters of Testing' when 3 then 'journal homepage: www.x' when 4 then concat('Research Policy ', p % 50 + 1, ' (2013) 15–20') else 'text' end")
    rows = _rows(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), "seq", text.alias("text"), F.expr("10.0D + s * 18").alias("y0"), F.expr("20.0D + s * 18").alias("y1"), F.lit(800.0).alias("height"))
    return S.mastheads(rows).select("doc_id", "seq", "text")


@query(f"""with {_BASE}, b as (select doc_id, seq, (p % 20) * 20.0 as x0, (p % 20) * 20.0 + 100 as x1, (s % 10) * 30.0 as y0, (s % 10) * 30.0 + 20 as y1, n from base)
select doc_id, seq from b a where n > 2 and not exists (select 1 from b t where t.n <= 2 and t.doc_id = a.doc_id and least(a.x1, t.x1) > greatest(a.x0, t.x0) and least(a.y1, t.y1 + 15) > greatest(a.y0, t.y0) and (least(a.x1, t.x1) - greatest(a.x0, t.x0)) * (least(a.y1, t.y1 + 15) - greatest(a.y0, t.y0)) > 0.6 * 100 * 20)""")
def d08_lines_outside_tables(spark, sf_dir):
    """Lines that no table of their page covers."""
    rows = _rows(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), "seq", "n", F.expr("(p % 20) * 20.0D").alias("x0"), F.expr("(p % 20) * 20.0D + 100").alias("x1"), F.expr("(s % 10) * 30.0D").alias("y0"), F.expr("(s % 10) * 30.0D + 20").alias("y1"))
    return S.lines_outside(rows.where("n > 2"), rows.where("n <= 2").withColumn("y1", F.col("y1") + 15)).select("doc_id", "seq")


@query(f"""with {_BASE}, w as (select doc_id, seq as n, seq * 30.0 as x0, seq * 30.0 + 25 as x1, 100.0 as y0, 110.0 as y1 from base), m as (select doc_id, seq as id, (p % 8) * 30.0 as x0, (p % 8) * 30.0 + 30 + s * 5 as x1, 95.0 + s % 12 as y0, 105.0 + s % 12 as y1, case when s % 2 = 0 then 'unclear' else 'split' end as reason from base where n % 2 = 0),
h as (select w.doc_id, w.n, arg_min(reason, id) as reason from w join m on m.doc_id = w.doc_id and least(w.x1, m.x1) - greatest(w.x0, m.x0) > 1 and least(w.y1, m.y1) - greatest(w.y0, m.y0) > 3 group by all),
i as (select *, n - row_number() over (partition by doc_id, reason order by n) as island from h) select doc_id, min(n) as first, max(n) as last, reason from i group by doc_id, reason, island""")
def d11_marked_words(spark, sf_dir):
    """Words under made-up marks."""
    rows = _rows(spark, sf_dir).withColumn("page", F.lit(0))
    words = rows.select("doc_id", "page", F.col("seq").alias("n"), F.expr("seq * 30.0D").alias("x0"), F.expr("seq * 30.0D + 25").alias("x1"), F.lit(100.0).alias("y0"), F.lit(110.0).alias("y1"))
    marks = rows.where("n % 2 = 0").select("doc_id", "page", F.col("seq").alias("id"), F.expr("(p % 8) * 30.0D").alias("x0"), F.expr("(p % 8) * 30.0D + 30 + s * 5").alias("x1"), F.expr("95.0D + s % 12").alias("y0"), F.expr("105.0D + s % 12").alias("y1"), F.when(F.col("s") % 2 == 0, "unclear").otherwise("split").alias("reason"))
    return S.marked_words(words, marks).select("doc_id", "first", "last", "reason")


@query(f"""with {_BASE}, m as (select doc_id, seq as id, [(s % 9)::int, (p % 20)::int] as r, s, p from base), x as (select doc_id, id, unnest(list_concat([(s % 9)::int], case when s between 1 and 29 then generate_series((p % 20)::int, (p % 20 + s)::int) else [(p % 20)::int, (p % 20 + s)::int] end)) as number,
  unnest(generate_series(0, case when s between 1 and 29 then s::int + 1 else 2 end)) as k from m) select doc_id, id, list('[' || number || '] R' || number order by k) as entries from x where number % 3 > 0 group by all""")
def d15_popups(spark, sf_dir):
    """What made-up markers point to, where references exist."""
    rows = _rows(spark, sf_dir)
    markers = rows.select("doc_id", F.col("seq").alias("id"), F.expr("concat(s % 9, ', ', p % 20, '-', p % 20 + s)").alias("spec"))
    named = markers.select("doc_id", F.explode(numbers(F.col("spec"), 30)).alias("number")).where("number % 3 > 0").distinct()
    refs = named.withColumn("text", F.concat(F.lit("R"), F.col("number").cast("string")))
    return L.popups(markers, refs)


@query(f"""with {_BASE}, r as (select doc_id, (p % 150)::int as a, (p % 150 + 5 + s)::int as z, (p * 3 % 101)::double as c, seq from base), q as (select doc_id, seq as id, (s * 11 + n * 7)::int as "at" from base)
select q.doc_id, q.id, q."at", arg_min(c, a * 100 + seq) as confidence from q left join r on r.doc_id = q.doc_id and a <= q."at" and q."at" < z group by all""")
def d20_confidences_at(spark, sf_dir):
    """The confidence of the first made-up range at a place."""
    rows = _rows(spark, sf_dir)
    first = F.struct("seq", F.expr("cast(p * 3 % 101 as double)").alias("c"))
    ranges = rows.select("doc_id", F.expr("cast(p % 150 as int)").alias("start"), F.expr("cast(p % 150 + 5 + s as int)").alias("end"), first.alias("confidence"))
    places = rows.select("doc_id", F.col("seq").alias("id"), F.expr("cast(s * 11 + n * 7 as int)").alias("at"))
    found = L.confidence_at(places, ranges, ["doc_id"])
    return found.select("doc_id", "id", "at", F.col("confidence.c").alias("confidence"))


@query(rf"""with {BLOCKS}, lex as (select distinct lower(unnest(regexp_extract_all(text, '\p{{L}}+'))) as word from benchmark), w as (select doc_id, seq, length(text) as n, unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) as word from blocks),
k as (select doc_id, seq, n, avg((lower(word) in (select word from lex))::int) as share, count(*) as words from w group by all) select doc_id, seq, share, n >= 15 and share < 0.6 as garbled from k""")
def a18_garbled_lines(spark, sf_dir):
    """Lines of which under 60 % of the words are known (E12)."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "seq", F.length("text").alias("n"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).withColumn("word", F.lower("w"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct().withColumn("known", F.lit(1))
    share = rows.join(known, "word", "left").groupBy("doc_id", "seq", "n").agg(F.avg(F.coalesce("known", F.lit(0))).alias("share"))
    return share.select("doc_id", F.col("seq").cast("long").alias("seq"), "share", ((F.col("n") >= 15) & (F.col("share") < 0.6)).alias("garbled"))


@query(f"""with {_BASE}, c as (select doc_id as id, 'w' || seq as word, (p % 40) / 20.0::double as score, (s % 3)::double as distance, 0.9::double as confidence from base), r as (select *, row_number() over o as k, lead(score) over o as nx from c window o as (partition by id order by score, distance, word))
select id, word, greatest(0.05, confidence - case when nx - score < 0.15 then 0.3 when nx - score < 0.5 then 0.1 else 0.0 end) as confidence from r where k = 1""")
def g02_best_candidates(spark, sf_dir):
    """The best of made-up candidates, less sure where the second is near."""
    rows = _rows(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("w"), F.col("seq").cast("string")).alias("word"), F.expr("(p % 40) / 20.0D").alias("score"), F.expr("cast(s % 3 as double)").alias("distance"), F.lit(0.9).alias("confidence"))
    return L.best_two(rows)


@query("""with q as (select o_orderkey, (['num ber', 'rnodel', 'pre- and post', 'same', 'the author wrote', 'self- report'])[o_orderkey % 6 + 1] as quote, (['number', 'model', 'pre-and post', 'same', 'the editor wrote', 'self-report'])[o_orderkey % 6 + 1] as fix, o_orderkey % 4 < 2 as scan from orders)
select o_orderkey, case o_orderkey % 6 when 0 then 'word' when 1 then case when scan then 'scan' end when 5 then 'word' end as kind, case when o_orderkey % 6 = 3 then true else list_sort(string_split(replace(quote, ' ', ''), '')) = list_sort(string_split(replace(fix, ' ', ''), '')) end as same from q""")
def c16_allowed_fixes(spark, sf_dir):
    """Which fixes are allowed, and whether they keep every sign (H06)."""
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.expr("cast(o_orderkey % 6 as int)"))
    quote, fix = pick(("num ber", "rnodel", "pre- and post", "same", "the author wrote", "self- report")), pick(("number", "model", "pre-and post", "same", "the editor wrote", "self-report"))
    source = F.when(F.col("o_orderkey") % 4 < 2, "ocr").otherwise("text")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.fix_kind(quote, fix, source).alias("kind"), L.same_symbols(quote, fix).alias("same"))


@query("""select o_orderkey, 4 as start, 4 + length('w' || o_orderkey) as "end", 'w' || o_orderkey as original, 'v' || o_orderkey || 'x' as replacement from orders""")
def i22_minimal_edits(spark, sf_dir):
    """What changed between two made-up sentences."""
    k = F.col("o_orderkey").cast("string")
    old, new = F.concat(F.lit("the w"), k, F.lit(" x end")), F.concat(F.lit("the v"), k, F.lit("x x end"))
    return table(spark, sf_dir, "orders").select("o_orderkey", O.minimal_edit(old, new).alias("e")).select("o_orderkey", "e.start", "e.end", "e.original", "e.replacement")


@query(f"""with {_BASE}, h as (select doc_id, seq, case s % 3 when 0 then (p % 9) || '.' || (s % 5) || ' Part' when 1 then (p % 9) || '. Part' else 'Part' end as text, (1 + p % 4)::int as level from base), m as (select doc_id, level, count(*) as k, min(seq) as f from h group by all), c as (select doc_id, arg_max(level, k * 1000 - f) as common from m group by doc_id)
select doc_id, seq, case when text like '%.%.%' or text like '%.% Part' and text not like '%. Part' then 2 when text like '%. Part' then 1 else common end as level from h join c using (doc_id)""")
def c17_split_heading_levels(spark, sf_dir):
    """Levels of headings split off paragraphs."""
    rows = _rows(spark, sf_dir).select("doc_id", "seq", F.expr("case s % 3 when 0 then concat(p % 9, '.', s % 5, ' Part') when 1 then concat(p % 9, '. Part') else 'Part' end").alias("text"), F.expr("cast(1 + p % 4 as int)").alias("level"))
    counted = rows.groupBy("doc_id", "level").agg(F.count("*").alias("k"), F.min("seq").alias("f"))
    common = counted.groupBy("doc_id").agg(F.max_by("level", F.struct("k", -F.col("f"))).alias("common"))
    return rows.join(common, "doc_id").select("doc_id", "seq", S.split_heading_level(F.col("text"), F.col("common")).alias("level"))


@query("""with k as (select o_orderkey, (['en', 'nl', 'xx'])[o_orderkey % 3 + 1] as lang, (['notes', 'note', 'figure'])[o_orderkey % 2 + 1] as key, o_orderkey % 50 as n from orders), l as (select * from (values ('en', 'notes', 'Notes'), ('en', 'note', 'Note {n}'), ('nl', 'note', 'Noot {n}')) v(lang, key, label))
select o_orderkey, replace(coalesce(a.label, b.label), '{n}', k.n::varchar) as label from k left join l a on a.lang = k.lang and a.key = k.key left join l b on b.lang = 'en' and b.key = k.key""")
def b10_labels(spark, sf_dir):
    """Added words by language, in English where a language has none."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("en", "nl", "xx"))), F.expr("cast(o_orderkey % 3 as int)")).alias("lang"), F.get(F.array(*map(F.lit, ("notes", "note"))), F.expr("cast(o_orderkey % 2 as int)")).alias("key"), F.expr("o_orderkey % 50").alias("n"))
    known = spark.createDataFrame([("en", "notes", "Notes"), ("en", "note", "Note {n}"), ("nl", "note", "Noot {n}")], "lang string, key string, label string")
    return C.labels(rows, known).select("o_orderkey", "label")


_LOOK = """with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents), lex as (select distinct word, case when length(word) % 2 = 0 then 'n' else 'v' end as pos from (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from benchmark)),
rules as (select * from (values {rules}) v(rank, pos, ending, put)), f as (select word, -1 as rank, '' as pos, word as base from w union all select word, rank, pos, substr(word, 1, length(word) - length(ending)) || put from w, rules where ends_with(word, ending) and length(word) > length(ending) + 1),
g as (select word, base, min(rank) as o, list(pos) as fits from f group by all), h as (select g.*, lex.pos from g join lex on lex.word = g.base), b as (select word, arg_min(base, o) as base from h group by word),
j as (select h.* , list_contains(fits, '') or list_contains(fits, h.pos) as ok from h join b using (word, base)) select word, base, pos from j where ok or not (select bool_or(k.ok) from j k where k.word = j.word)"""
_RULES = ", ".join(f"({2 * k + 2}, '{p}', '{e}', '{b}')" for k, (p, e, b) in enumerate((p, e, b) for p, found in Sp.INFLECTIONS.items() for e, b in found))


@query(_LOOK.replace("{rules}", _RULES))
def d17_dictionary_forms(spark, sf_dir):
    """Words under their dictionary forms (the benchmark's words as entries with one made-up sense; G04)."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    lexicon = words("benchmark").select("word", F.when(F.length("word") % 2 == 0, "n").otherwise("v").alias("pos"), F.lit(1).alias("rank"), F.lit("meaning").alias("meaning"))
    none = spark.createDataFrame([], "word string, pos string, base string")
    return Sp.lookups(words("documents"), lexicon, none).select("word", "base", "pos")
