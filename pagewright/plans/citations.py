"""Queries of citations, overlays and packing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import citations as C
from ..functions import overlay as O
from ..functions import packing as P
from ..functions import text as X
from ..functions.spans import keep_first
from ..operators import links as L
from ..operators.blocks import lines, table
from .registry import BLOCKS, query

# A text made from an order line: a bracket, a citation, a loose one and none.
_A, _B = "(l_suppkey % 9 + 1)", "(l_partkey % 60 + 1)"
_TEXT = f"""'Seen in [' || {_A} || ', ' || {_B} || '-' || ({_B} + l_linenumber) || '] and (Name' || chr(97 + l_linenumber::int) || ', ' || (1950 + l_suppkey % 50) || '; Doe & Roe, 2001) or (Later in ' || (1900 + l_linenumber) || ' text) but (x = 1999).'"""
_ROWS = "(select distinct l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem)"


def _made(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    s = lambda e: F.expr(f"cast({e} as string)")
    a, b = "l_suppkey % 9 + 1", "l_partkey % 60 + 1"
    text = F.concat(
        F.lit("Seen in ["), s(a), F.lit(", "), s(b), F.lit("-"), s(f"{b} + l_linenumber"), F.lit("] and (Name"), F.expr("chr(97 + l_linenumber)"), F.lit(", "), s("1950 + l_suppkey % 50"),
        F.lit("; Doe & Roe, 2001) or (Later in "), s("1900 + l_linenumber"), F.lit(" text) but (x = 1999)."),
    )
    return rows.withColumn("text", text)


@query(f"""with made as (select *, {_TEXT} as text from {_ROWS}), spots as (
  select l_orderkey, l_linenumber, l_suppkey, l_partkey, text, 'numeric' as kind, instr(text, '[') - 1 as start, instr(text, ']') as e,
    list_transform(list_concat([{_A}], generate_series({_B}, {_B} + l_linenumber)), lambda v: v::varchar) as items,
    case when greatest({_A}, {_B} + l_linenumber) <= 40 then 0.97 else 0.4 end as confidence from made
  union all select l_orderkey, l_linenumber, l_suppkey, l_partkey, text, 'author_date', instr(text, '(Name') - 1, instr(text, ' or (Later') - 1, ['Name' || chr(97 + l_linenumber::int) || ', ' || (1950 + l_suppkey % 50), 'Doe & Roe, 2001'], 0.97 from made
  union all select l_orderkey, l_linenumber, l_suppkey, l_partkey, text, 'author_date', instr(text, '(Later') - 1, instr(text, ' but (x') - 1, ['Later in ' || (1900 + l_linenumber) || ' text'], 0.55 from made
) select l_orderkey, l_linenumber, l_suppkey, l_partkey, start::int as start, e::int as "end", kind, items, confidence::double as confidence from spots""")
def i04_citations(spark, sf_dir):
    """Citations of made-up texts with a list of 40 references (ranges: I05)."""
    found = _made(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.explode(C.find(F.col("text"), F.lit(40))).alias("c"))
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "c.start", "c.end", "c.kind", "c.items", "c.confidence")


@query(f"""select l_orderkey, l_linenumber, l_suppkey, l_partkey, 'Seen in and or but (x = 1999).' as bare from (select *, {_TEXT} as text from {_ROWS})""")
def i06_without_citations(spark, sf_dir):
    """Made-up texts without their citations."""
    return _made(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", C.strip(F.col("text")).alias("bare"))


@query("""with refs as (select s_suppkey as idx, 'Name' || chr(97 + (s_suppkey % 8)::int) || ', A. (' || (1950 + s_suppkey % 50) || '). Title ' || s_suppkey as text, 'Name' || chr(97 + (s_suppkey % 8)::int) as sn, (1950 + s_suppkey % 50)::varchar as yr from supplier),
items as (select distinct 'Name' || chr(97 + l_linenumber::int) as sn, (1950 + l_suppkey % 50)::varchar as yr from lineitem),
hits as (select items.sn, items.yr, list(idx) as found from items join refs using (sn, yr) group by all)
select i.sn || ', ' || i.yr as item, case when len(h.found) = 1 then h.found[1] else -1 end as reference from items i left join hits h using (sn, yr)""")
def d01_matched_references(spark, sf_dir):
    """Made-up items matched to a list of references made from suppliers."""
    letter = F.expr("chr(97 + s_suppkey % 8)")
    refs = table(spark, sf_dir, "supplier").select(
        F.lit("d").alias("doc_id"), F.col("s_suppkey").alias("idx"), F.concat(F.lit("Name"), letter, F.lit(", A. ("), F.expr("cast(1950 + s_suppkey % 50 as string)"), F.lit("). Title "), F.col("s_suppkey").cast("string")).alias("text")
    )
    items = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.expr("concat('Name', chr(97 + l_linenumber), ', ', cast(1950 + l_suppkey % 50 as string))").alias("item")).distinct()
    return L.match_references(items, refs).select("item", F.col("reference").alias("reference"))


@query("""with items as (select l_orderkey as doc, 'Name' || chr(97 + (l_partkey % 20)::int) as item, min(l_linenumber * 1000000 + l_partkey) as first from lineitem group by all),
numbered as (select doc, item, first, case when (ascii(right(item, 1)) - 97) < 10 then ascii(right(item, 1)) - 96 end as ref from items)
select doc, item, coalesce(ref, 10 + row_number() over (partition by doc, ref is null order by first))::bigint as number from numbered""")
def f15_citation_numbers(spark, sf_dir):
    """Numbers of cited items: the reference's own, else after the list of 10 in order of appearance (D05)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.expr("concat('Name', chr(97 + l_partkey % 20))").alias("item"), F.expr("l_linenumber * 1000000 + l_partkey").alias("seq"))
    n = F.ascii(F.substring("item", -1, 1)) - 96
    rows = rows.withColumn("reference", F.when(n <= 10, n.cast("long")))
    return L.number_items(rows, "doc", 10)


@query("""with marks as (select l_orderkey as doc, l_linenumber as n, l_partkey, l_suppkey, l_extendedprice, l_linenumber as page, (l_suppkey % 4)::varchar as label from lineitem),
notes as (select o_orderkey as doc, p as page, l::varchar as label, 10 * p + l as note from orders, (select unnest([2, 3, 5]) as p), (select unnest([0, 1, 2]) as l) where (o_orderkey + p + l) % 3 > 0)
select m.doc, m.n, m.l_partkey, m.l_suppkey, m.l_extendedprice, coalesce(a.note, b.note)::bigint as note from marks m left join notes a on a.doc = m.doc and a.page = m.page and a.label = m.label left join notes b on b.doc = m.doc and b.page = m.page + 1 and b.label = m.label""")
def d02_footnotes_of_markers(spark, sf_dir):
    """The note a marker points to: on its page, else on the next."""
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_linenumber").alias("page"), F.expr("cast(l_suppkey % 4 as string)").alias("label"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*map(F.lit, (2, 3, 5)))).alias("page"))
    notes = notes.select("doc", "page", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("l")).where("(doc + page + l) % 3 > 0")
    notes = notes.select("doc", F.col("page").cast("long").alias("page"), F.col("l").cast("string").alias("label"), F.expr("cast(10 * page + l as bigint)").alias("note"))
    return L.notes_of_markers(marks, notes).select("doc", "n", "l_partkey", "l_suppkey", "l_extendedprice", "note")


_SPOTS = """select l_orderkey as block, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, (l_partkey % 200)::int as s, (l_partkey % 200 + 1 + l_suppkey % 70)::int as e,
  case l_linenumber % 3 when 0 then 'user' when 1 then 'dictionary' else 'ai' end as source, case l_suppkey % 4 when 0 then 'pending' when 1 then 'auto' when 2 then 'accepted' else 'rejected' end as status from lineitem"""


def _spots(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"),
        F.row_number().over(order).cast("long").alias("id"),
        F.expr("cast(l_partkey % 200 as int)").alias("start"),
        F.expr("cast(l_partkey % 200 + 1 + l_suppkey % 70 as int)").alias("end"),
        F.expr("case l_linenumber % 3 when 0 then 'user' when 1 then 'dictionary' else 'ai' end").alias("source"),
        F.expr("case l_suppkey % 4 when 0 then 'pending' when 1 then 'auto' when 2 then 'accepted' else 'rejected' end").alias("status"),
    )


@query(f"""with c as ({_SPOTS}), live as (select * from c where status in ('auto', 'accepted'))
select block, id, s as start, e as "end", source from live a where source = 'user' or not exists (select 1 from live u where u.source = 'user' and u.block = a.block and u.s < a.e and a.s < u.e)""")
def d06_effective_corrections(spark, sf_dir):
    """Applied corrections that no correction by hand overlaps."""
    return L.effective_corrections(_spots(spark, sf_dir), ["block"]).select("block", "id", "start", "end", "source")


@query(f"""with c as ({_SPOTS}) select block, id, s as start, e as "end", status from c a where status = 'pending' and not exists (
  select 1 from c u where u.source = 'user' and u.status in ('auto', 'accepted') and u.block = a.block and u.s < a.e and a.s < u.e)""")
def l06_review_queue(spark, sf_dir):
    """Suggestions still to decide on."""
    c = _spots(spark, sf_dir)
    hand = c.where("source in ('user', 'check') and status in ('auto', 'accepted')")
    return L.without_overlap(c.where("status = 'pending'"), hand, ["block"]).select("block", "id", "start", "end", "status")


@query(f"""with c as ({_SPOTS}), packed as (select block, list([{{'id': id, 's': s, 'e': e}}] order by id) as x from c group by block),
kept as (select block, list_reduce(x, lambda acc, y: case when len(list_filter(acc, lambda z: z.s < y[1].e and y[1].s < z.e)) > 0 then acc else list_concat(acc, y) end) as k from packed)
select block, unnest(k).id as id, unnest(k).s as start, unnest(k).e as "end" from kept""")
def h04_first_of_overlapping(spark, sf_dir):
    """Spans of a block, each kept unless it overlaps one kept before."""
    spots = _spots(spark, sf_dir).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "start", "end"))).alias("x"))
    kept = spots.select("block", F.explode(keep_first(F.col("x"))).alias("k"))
    return kept.select("block", "k.id", "k.start", "k.end")


_WORDS = [("alpha", 0, 5), ("beta", 6, 10), ("gamma", 11, 16), ("delta", 17, 22)]
_FIXES = """select l_orderkey as block, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, (l_linenumber % 4)::int as w,
  case when l_partkey % 5 = 0 then 'other' else (['alpha', 'beta', 'gamma', 'delta'])[(l_linenumber % 4)::int + 1] end as original, repeat('x', (l_suppkey % 9)::int) as replacement,
  case l_suppkey % 4 when 0 then 'pending' when 1 then 'auto' when 2 then 'accepted' else 'rejected' end as status, case l_partkey % 3 when 0 then 'user' when 1 then 'dictionary' else 'ligature' end as source from lineitem"""


def _fixes(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = F.expr("cast(l_linenumber % 4 as int)")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _WORDS)), w + 1)
    fix = F.struct(
        F.row_number().over(order).alias("id"),
        pick(1).alias("start"),
        pick(2).alias("end"),
        F.when(F.col("l_partkey") % 5 == 0, "other").otherwise(pick(0)).alias("original"),
        F.expr("repeat('x', cast(l_suppkey % 9 as int))").alias("replacement"),
        F.expr("case l_suppkey % 4 when 0 then 'pending' when 1 then 'auto' when 2 then 'accepted' else 'rejected' end").alias("status"),
        F.expr("case l_partkey % 3 when 0 then 'user' when 1 then 'dictionary' else 'ligature' end").alias("source"),
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), fix.alias("c"))
    return rows.groupBy("block").agg(F.array_sort(F.collect_list("c")).alias("fixes")).withColumn("text", F.lit("alpha beta gamma delta end"))


_CHOSEN = f"""with c as ({_FIXES}), live as (select * from c where status in ('auto', 'accepted')),
good as (select * from live a where source = 'user' or not exists (select 1 from live u where u.block = a.block and u.w = a.w and u.source = 'user')),
standing as (select * from good where original <> 'other'),
won as (select block, w, arg_min(replacement, id) as r from standing group by all),
each as (select b.block, k.w, k.word, coalesce(won.r, k.word) as shown from (select distinct l_orderkey as block from lineitem) b, (values (0, 'alpha'), (1, 'beta'), (2, 'gamma'), (3, 'delta')) k(w, word) left join won on won.block = b.block and won.w = k.w)"""


@query(_CHOSEN + """ select block, string_agg(shown, ' ' order by w) || ' end' as shown from each group by block""")
def i17_corrected_texts(spark, sf_dir):
    """Made-up texts with their corrections put in."""
    return _fixes(spark, sf_dir).select("block", O.apply(F.col("text"), F.col("fixes")).alias("shown"))


@query(
    _CHOSEN
    + """, n as (select block, w, count(*) as k from standing group by all), once as (select block from n group by block having max(k) = 1 union select block from (select distinct l_orderkey as block from lineitem) where block not in (select block from standing))
select block, (sum(length(shown) + 1) - 1)::int as before_end, sum(case when w < 2 then length(shown) + 1 else 0 end)::int as gamma_at from each where block in (select block from once) group by block"""
)
def i18_shifted_places(spark, sf_dir):
    """Where two places of a text are after its corrections (texts with one fix for a word at most)."""
    rows = _fixes(spark, sf_dir)
    standing = F.filter(O.effective(F.col("fixes")), lambda c: c["original"] != "other")
    once = F.size(F.array_distinct(F.transform(standing, lambda c: c["start"]))) == F.size(standing)
    at = lambda p: O.shift(F.lit(p), F.col("text"), F.col("fixes"))
    return rows.where(once).select("block", at(22).alias("before_end"), at(11).alias("gamma_at"))


_N = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query(rf"""with {BLOCKS}, sized as (select doc_id, list({{'used': {_N}::int, 'part': 0, 'out': [0]}} order by seq) as x from blocks group by doc_id),
done as (select doc_id, list_reduce(x, lambda acc, y: {{'used': case when acc.used + y.used > 1800 then y.used else acc.used + y.used end, 'part': case when acc.used + y.used > 1800 then acc.part + 1 else acc.part end,
  'out': list_append(acc.out, case when acc.used + y.used > 1800 then acc.part + 1 else acc.part end)}}).out as parts from sized)
select doc_id, unnest(generate_series(0, len(parts) - 1)) as seq, unnest(parts) as part from done""")
def f17_check_parts(spark, sf_dir):
    """Blocks packed into parts of at most 1800 words."""
    docs = table(spark, sf_dir, "documents")
    sizes = F.transform(F.split("text", "\n"), lambda b: F.size(X.words(b)))
    found = docs.select("doc_id", F.posexplode(P.parts(sizes, 1800)).alias("seq", "part"))
    return found.withColumn("seq", F.col("seq").cast("long"))


_SENTENCES = r"""list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"""


@query(rf"""with s as (select doc_id, list_transform({_SENTENCES}, lambda x: [x]) as x from documents), done as (
  select doc_id, case when len(x) = 0 then [] else list_reduce(x, lambda acc, y: case when length(acc[-1]) + 1 + length(y[1]) <= 600 then list_concat(acc[1:len(acc) - 1], [acc[-1] || ' ' || y[1]]) else list_concat(acc, y) end) end as parts from s)
select doc_id, unnest(generate_series(0, len(parts) - 1)) as n, length(unnest(parts)) as chars, md5(unnest(parts)) as part from done where len(parts) > 0""")
def f18_audio_parts(spark, sf_dir):
    """Sentences packed into texts of at most 600 characters."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.char_parts(X.sentences(F.col("text")))).alias("n", "part"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.length("part").cast("long").alias("chars"), F.md5("part").alias("part"))


_ABBR = ", ".join(f"'{a}'" for a in P.ABBREVIATIONS)
_STOPS = rf"""with w as (select doc_id, unnest(x) as word, unnest(generate_series(0, len(x) - 1)) as n from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as x from documents)),
nxt as (select *, lead(word) over (partition by doc_id order by n) as following from w),
stops as (select *, case when not regexp_matches(word, '[.!?…]["''”’)\]]*$') then word like '%:' and coalesce(regexp_matches(following, '^\p{{Lu}}'), false)
  when lower(word) in ({_ABBR}) or regexp_full_match(word, '(?:[A-Za-z]\.)+') then false else following is null or not regexp_matches(following, '^\p{{Ll}}') end as stop from nxt)"""


@query(_STOPS + """ select doc_id, n, coalesce(sum(stop::int) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as sentence from stops""")
def f12_sentence_of_words(spark, sf_dir):
    """The sentence each word is in."""
    found = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.posexplode(P.units(P.ends(F.col("w")), 1 << 30)).alias("n", "sentence"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.col("sentence").cast("long").alias("sentence"))


@query(
    _STOPS
    + """, packed as (select doc_id, list({'used': 1, 'unit': 0, 'stop': stop, 'out': [0]} order by n) as x from stops group by doc_id),
done as (select doc_id, list_reduce(x, lambda acc, y: {'used': case when acc.stop or acc.used >= 60 then 1 else acc.used + 1 end, 'unit': case when acc.stop or acc.used >= 60 then acc.unit + 1 else acc.unit end, 'stop': y.stop,
  'out': list_append(acc.out, case when acc.stop or acc.used >= 60 then acc.unit + 1 else acc.unit end)}).out as u from packed)
select doc_id, unit, count(*) as n_words from (select doc_id, unnest(u) as unit from done) group by all"""
)
def f13_reading_units(spark, sf_dir):
    """Units read aloud: sentences, in parts of at most 60 words."""
    found = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.explode(P.units(P.ends(F.col("w")))).alias("unit"))
    return found.groupBy("doc_id", "unit").agg(F.count("*").alias("n_words"))


# The documents' own lines end with a mark; every fifth loses it here, and the line after it its capital.
_CUT = "case seq % 5 when 2 then regexp_replace(text, '[.!?:;”\"’)\\]]+$', '') when 3 then lower(text) else text end"


@query(rf"""with {BLOCKS}, cut as (select doc_id, seq, {_CUT} as text from blocks), p as (select doc_id, seq, text, lead(text) over (partition by doc_id order by seq) as following, lead(seq) over (partition by doc_id order by seq) as next_seq from cut where trim(text) <> '')
select doc_id, seq, next_seq, regexp_extract(trim(text), '(\S+)$', 1) as last_word, regexp_extract(trim(following), '^(\S+)', 1) as first_word from p
where following is not null and not regexp_matches(trim(text), '[.!?:;”"’)\]]$') and regexp_matches(trim(following), '^\p{{Ll}}')""")
def f11_split_sentences(spark, sf_dir):
    """Sentences that seem to be split over two paragraphs."""
    t = F.col("text")
    cut = F.when(F.col("seq") % 5 == 2, F.regexp_replace(t, "[.!?:;”\"’)\\]]+$", "")).when(F.col("seq") % 5 == 3, F.lower(t)).otherwise(t)
    rows = lines(table(spark, sf_dir, "documents")).withColumn("text", cut).where("trim(text) <> ''")
    order = W.partitionBy("doc_id").orderBy("seq")
    rows = rows.select("doc_id", "seq", F.trim("text").alias("text"), F.trim(F.lead("text").over(order)).alias("following"), F.lead("seq").over(order).alias("next_seq"))
    rows = rows.where(~F.col("text").rlike(r"[.!?:;”\"’)\]]$") & F.col("following").rlike(r"^\p{Ll}"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("next_seq").cast("long").alias("next_seq"), F.regexp_extract("text", r"(\S+)$", 1).alias("last_word"), F.regexp_extract("following", r"^(\S+)", 1).alias("first_word"))
