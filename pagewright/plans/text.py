"""Queries of the text group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import lines, table
from .registry import BLOCKS, query

TOKEN = X.TOKEN.replace("'", "''")
_SCORES = ", ".join(
    f"{{'n': len(list_filter(t, lambda w: list_contains([{', '.join(repr(w) for w in ws)}], w))), 'rank': {-k}, 'lang': '{lang}'}}" for k, (lang, ws) in enumerate(X.STOPWORDS.items())
)
_VOTE = f"""voted as (
  select doc_id, list_max([{_SCORES}]) as best
  from (select doc_id, list_transform(regexp_extract_all(substr(text, 1, {X.SAMPLE}), '{TOKEN}'), lambda w: lower(w)) as t from documents)
)"""


@query(f"""with {BLOCKS}, {_VOTE}
select b.doc_id, case when best.n > 0 then best.lang else 'en' end as language, count(*) as n_blocks, sum(length(b.text))::bigint as n_chars,
  sum(len(regexp_extract_all(b.text, '{TOKEN}')))::bigint as n_tokens
from blocks b join voted using (doc_id) group by all""")
def e02_block_language(spark, sf_dir):
    """Each document's language by common words, with its blocks and tokens counted."""
    docs = table(spark, sf_dir, "documents")
    # no token holds a line end, so that a text's tokens are its blocks' tokens
    n = F.regexp_count("text", F.lit("\n")) + 1
    tokens = F.regexp_count("text", F.lit(X.TOKEN))
    counts = [n.cast("long").alias("n_blocks"), (F.length("text") - n + 1).cast("long").alias("n_chars"), tokens.cast("long").alias("n_tokens")]
    return docs.select("doc_id", X.language(F.col("text")).alias("language"), *counts)


@query(f"""with {BLOCKS}, found as (
  select doc_id, seq, unnest(regexp_extract_all(text, '{TOKEN}')) as token, unnest(regexp_split_to_array(text, '{TOKEN}')[1:len(regexp_extract_all(text, '{TOKEN}'))]) as gap,
    unnest(generate_series(0, len(regexp_extract_all(text, '{TOKEN}')) - 1)) as n
  from blocks where regexp_matches(text, '{TOKEN}')
), placed as (select *, sum(length(gap) + length(token)) over (partition by doc_id, seq order by n) as e from found)
select doc_id, seq, n, token, (e - length(token))::int as start, e::int as "end" from placed""")
def i01_tokens(spark, sf_dir):
    """All tokens with their places."""
    found = lines(table(spark, sf_dir, "documents")).select("doc_id", "seq", F.posexplode(X.token_spans(F.col("text"))).alias("n", "x"))
    return found.select("doc_id", "seq", F.col("n").cast("long").alias("n"), F.col("x.text").alias("token"), "x.start", "x.end")


@query(f"""select doc_id, token, count(*) as n from (select doc_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) as token from documents) group by all""")
def e03_token_counts(spark, sf_dir):
    """Frequencies of lower-case tokens by document."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(X.tokens(F.col("text")), lambda w: F.lower(w))).alias("token"))
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_W = r"[\p{L}\p{N}_.]"
_NUM = rf"(^|[^\p{{L}}\p{{N}}_.])\+?[0-9][0-9 ./-]{{6,}}[0-9]([^\p{{L}}\p{{N}}_.]|$)"


@query(rf"""with a as (select doc_id, regexp_replace(regexp_replace(text, '{X.EMAIL}', '[email]', 'g'), '{X.LINK}', '[link]', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{10,30}}([^\p{{L}}\p{{N}}_]|$)', '\1[account]\2', 'g'), '(^|[^\p{{L}}\p{{N}}_.])({X.YEARS})([^0-9 ./\p{{L}}\p{{N}}_-]|$)', '\1' || chr(1) || '\3', 'g') as t from a)
select doc_id, length(t) as n_chars, md5(t) as masked from (select doc_id, regexp_replace(regexp_replace(t, '{_NUM}', '\1[number]\2', 'g'), '{_NUM}', '\1[number]\2', 'g') as t from b)""")
def i07_masked(spark, sf_dir):
    """Documents with personal details masked."""
    masked = X.mask(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(masked).alias("n_chars"), F.md5(masked).alias("masked"))


@query(r"""select event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'sk-ant-[A-Za-z0-9_\-]{8,}', '[API key hidden]', 'g'), 'AIza[0-9A-Za-z_\-]{20,}', '[API key hidden]', 'g'),
  'mstrl_[A-Za-z0-9_\-]{8,}', '[API key hidden]', 'g'), '(?i)(?:x-api-key|x-goog-api-key|authorization)["'']?\s*[:=]\s*["'']?[^\s"'',}]+', '[API key hidden]', 'g') as shown
from (select event_id, case event_id % 4 when 0 then 'sk-ant-' || md5(event_id::varchar) when 1 then 'x-api-key: ' || md5(event_id::varchar) || ', more' when 2 then 'use mstrl_' || md5(event_id::varchar) || ' now' else 'no key ' || event_id::varchar end as t from events)""")
def i08_redacted(spark, sf_dir):
    """Texts with keys hidden (keys made from event ids)."""
    i = F.col("event_id")
    digest = F.md5(i.cast("string"))
    made = (
        F.when(i % 4 == 0, F.concat(F.lit("sk-ant-"), digest))
        .when(i % 4 == 1, F.concat(F.lit("x-api-key: "), digest, F.lit(", more")))
        .when(i % 4 == 2, F.concat(F.lit("use mstrl_"), digest, F.lit(" now")))
        .otherwise(F.concat(F.lit("no key "), i.cast("string")))
    )
    return table(spark, sf_dir, "events").select("event_id", X.redact(made).alias("shown"))


@query(rf"""with {BLOCKS}, keyed as (
  select doc_id, seq, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(trim(text)), '[^\p{{L}}\p{{N}}_\s]|\p{{Nd}}', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ') as k from blocks
) select case when k = '' then '0' else k end as key, count(*) as n_blocks, count(distinct doc_id) as n_docs from keyed group by 1 having count(distinct doc_id) > 1""")
def c15_repeated_lines(spark, sf_dir):
    """Keys of lines that several documents hold."""
    keyed = lines(table(spark, sf_dir, "documents")).select("doc_id", X.furniture_key(F.col("text")).alias("key"))
    # one row for each document and key first, so that a very common line is counted where it stands
    each = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.sum("n").alias("n_blocks"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query(r"""select doc_id, unnest(generate_series(0, len(s) - 1)) as n, unnest(s) as sentence from (
  select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents)""")
def i29_sentences(spark, sf_dir):
    """Sentences by document."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))
    return found.withColumn("n", F.col("n").cast("long"))


@query("""select word, length(word) as len, case when length(word) <= 0 then 0 else 1 end as first, case when length(word) <= 0 then 0 else greatest(1, ceil(length(word) * 25 / 100.0))::int end as quarter,
  case when length(word) <= 0 then 0 when length(word) <= 3 then 1 when length(word) <= 5 then 2 else ceil(length(word) * 0.4)::int end as automatic
from (select distinct unnest(regexp_extract_all(text, '[\\p{L}]+')) as word from benchmark)""")
def i02_bold_lengths(spark, sf_dir):
    """Bold lengths of the benchmark's words."""
    found = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    n = F.length("word")
    return found.select("word", n.alias("len"), X.bold_length(n, "first_letter").alias("first"), X.bold_length(n, "25").alias("quarter"), X.bold_length(n).alias("automatic"))


_CHUNK = r"""with chunks as (
  select item_id, unnest(regexp_extract_all(text, '\S+')) as c, unnest(regexp_split_to_array(text, '\S+')[1:len(regexp_extract_all(text, '\S+'))]) as gap, unnest(generate_series(0, len(regexp_extract_all(text, '\S+')) - 1)) as k
  from (select event_id as item_id, 'Read www.a' || event_id || '.org and THE file_' || event_id || ' of camelCase l''eau at x@y.org or a.b.c plain' as text from events)
), placed as (select *, sum(length(gap) + length(c)) over (partition by item_id order by k) - length(c) as s from chunks),
words as (
  select item_id, s, c, unnest(regexp_extract_all(c, '[\p{L}]+(?:[''’][\p{L}]+)*')) as w, unnest(regexp_split_to_array(c, '[\p{L}]+(?:[''’][\p{L}]+)*')[1:len(regexp_extract_all(c, '[\p{L}]+(?:[''’][\p{L}]+)*'))]) as g,
    unnest(generate_series(0, len(regexp_extract_all(c, '[\p{L}]+(?:[''’][\p{L}]+)*')) - 1)) as n
  from placed where not regexp_matches(c, '(?i:https?://|www\.|doi:)|\S+@\S+\.\w+|[_/\\]|[0-9]|[a-z]+[A-Z]\w*|\w+\.\w+\.\w+') and regexp_matches(c, '\p{L}')
), located as (select *, s + sum(length(g) + length(w)) over (partition by item_id, s order by n) - length(w) as a from words)
select item_id, a::int as start, (a + case when length(w) <= 3 then 1 when length(w) <= 5 then 2 else ceil(length(w) * 0.4) end)::int as "end" from located where not (upper(w) = w and length(w) > 1)"""


@query(_CHUNK)
def i03_bold_ranges(spark, sf_dir):
    """Bold beginnings in made-up lines with links, codes and capitals."""
    i = F.col("event_id").cast("string")
    made = F.concat(F.lit("Read www.a"), i, F.lit(".org and THE file_"), i, F.lit(" of camelCase l'eau at x@y.org or a.b.c plain"))
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.explode(X.bold_ranges(made)).alias("x"))
    return found.select("item_id", "x.start", "x.end")


@query(r"""select word, lang, 'https://' || case when regexp_full_match(lang, '[a-z]{2,3}') then lang else 'en' end || '.wiktionary.org/wiki/' ||
  replace(url_encode(lower(regexp_replace(replace(word, '’', ''''), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g'))), '+', '%20') as url
from (select distinct unnest(regexp_extract_all(text, '\S+')) as word, lang from documents)""")
def i28_lookup_urls(spark, sf_dir):
    """Links to look the documents' words up."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.explode(X.words(F.col("text"))).alias("word"), "lang").distinct()
    return found.select("word", "lang", X.lookup_url(F.col("word"), F.col("lang")).alias("url"))


@query("""select a.l_orderkey, a.l_linenumber, (a.l_linenumber > b.l_linenumber or (a.l_linenumber = b.l_linenumber and a.l_suppkey % 20 > b.l_suppkey % 20)) as newer
from (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem) a join (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem) b on a.l_orderkey = b.l_orderkey""")
def i31_newer_versions(spark, sf_dir):
    """Versions made from order lines, compared within an order."""
    v = lambda p: F.concat(F.lit("v"), F.col(f"{p}.l_linenumber").cast("string"), F.lit("."), (F.col(f"{p}.l_suppkey") % 20).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    both = rows.alias("a").join(rows.alias("b"), F.col("a.l_orderkey") == F.col("b.l_orderkey"))
    return both.select("a.l_orderkey", "a.l_linenumber", X.is_newer(v("a"), v("b")).alias("newer"))


@query("""select doc_id, sha256(source || chr(31) || lang || chr(31) || doc_id) as key, sha1(source || chr(31) || lang)[1:16] as short from documents""")
def i32_cache_keys(spark, sf_dir):
    """Keys of cached answers."""
    docs = table(spark, sf_dir, "documents")
    short = F.substring(F.sha1(F.concat_ws("\x1f", "source", "lang")), 1, 16)
    return docs.select("doc_id", X.cache_key(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("key"), short.alias("short"))


_UPPER = r"regexp_replace(text, '\P{L}', '', 'g')"


@query(rf"""with {BLOCKS} select doc_id, seq,
  (length({_UPPER}) >= 4 and not regexp_matches({_UPPER}, '[^\p{{Lu}}]') and len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 10) as capitals,
  (len(w) between 2 and 12 and regexp_matches(regexp_replace(text, '^["''“‘(]+', ''), '^\p{{Lu}}') and len(l) > 0 and len(list_filter(l, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / len(l) >= 0.75) as title,
  (text = '' or len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s.,;:''"()–—‘’“”?!&/-]')) / length(text) > 0.04 or contains(text, '^') or regexp_matches(text, '[A-Za-z]{{23,}}')) as garbled
from (select *, list_filter(w, lambda x: length(x) > 3) as l from (select *, regexp_extract_all(text, '[A-Za-zÀ-ɏ][\p{{L}}\p{{N}}_''’-]*') as w from blocks))""")
def c07_line_shapes(spark, sf_dir):
    """Lines in capitals, in title case, or garbled."""
    t = F.col("text")
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "seq", X.upper_heading(t).alias("capitals"), X.title_case(t).alias("title"), X.garbled(t).alias("garbled"))


_MADE_LINES = """case l_linenumber when 1 then 'Fig. ' || l_suppkey || '. Growth' when 2 then 'Table ' || l_suppkey || ' shows it' when 3 then l_suppkey || '.2 Method' when 4 then '• item ' || l_suppkey
  when 5 then 'page ' || l_suppkey || ' of 90' when 6 then 'References' else 'Abstract:' end"""


def _made_line():
    n, s = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    return (
        F.when(n == 1, F.concat(F.lit("Fig. "), s, F.lit(". Growth")))
        .when(n == 2, F.concat(F.lit("Table "), s, F.lit(" shows it")))
        .when(n == 3, F.concat(s, F.lit(".2 Method")))
        .when(n == 4, F.concat(F.lit("• item "), s))
        .when(n == 5, F.concat(F.lit("page "), s, F.lit(" of 90")))
        .when(n == 6, F.lit("References"))
        .otherwise(F.lit("Abstract:"))
    )


_CASES = " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in X.LINE_CLASSES.items())


@query(rf"""select t as line, case {_CASES} end as class, (regexp_matches(t, '{X.CAPTION}') and not regexp_matches(t, '{X.CAPTION_IN_PROSE}')) as caption,
  trim(regexp_extract(t, '({X.LINE_CLASSES["list_item"]})', 1)) as marker, count(*) as n from (select {_MADE_LINES} as t from lineitem) group by all""")
def i33_line_classes(spark, sf_dir):
    """Classes, caption test (C04) and list markers (I27) of made-up lines."""
    made = table(spark, sf_dir, "lineitem").select(_made_line().alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    t = F.col("line")
    return made.select("line", X.line_class(t).alias("class"), X.is_caption(t).alias("caption"), X.list_marker(t)["marker"].alias("marker"), "n")


@query(r"""select f as name, lower(regexp_replace(regexp_split_to_array(regexp_replace(f, '^[A-Z]{6}\+', ''), '[-,]')[1], '(?i)(bold|italic|oblique|regular|roman|medium|light|semibold|black|mt|ps)+$', '')) as family,
  (regexp_matches(f, '(?i)bold|black|heavy|semibold|demi') or (n & 16) > 0) as bold, (regexp_matches(f, '(?i)italic|oblique') or (n & 2) > 0) as italic
from (select n_nationkey as n, 'ABCDEF+' || replace(n_name, ' ', '') || case n_nationkey % 3 when 0 then 'BoldMT' when 1 then '-Italic' else 'PS-Roman' end as f from nation)""")
def i34_font_names(spark, sf_dir):
    """Font families and flags (A39) of made-up names."""
    n = F.col("n_nationkey")
    f = F.concat(F.lit("ABCDEF+"), F.replace(F.col("n_name"), F.lit(" "), F.lit("")), F.when(n % 3 == 0, "BoldMT").when(n % 3 == 1, "-Italic").otherwise("PS-Roman"))
    rows = table(spark, sf_dir, "nation").select(n.alias("n"), f.alias("name"))
    bold = F.col("name").rlike("(?i)bold|black|heavy|semibold|demi") | (F.col("n").bitwiseAND(16) > 0)
    italic = F.col("name").rlike("(?i)italic|oblique") | (F.col("n").bitwiseAND(2) > 0)
    return rows.select("name", X.font_family(F.col("name")).alias("family"), bold.alias("bold"), italic.alias("italic"))


@query(r"""select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n_words, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / (165 * 1.2) as minutes,
  md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as tidy,
  case when length(text) > 220 then substr(text, 1, case when instr(substr(text, 1, 220), ' ') > 0 then 220 - instr(reverse(substr(text, 1, 220)), ' ') else 220 end) || '…' else text end as clip from documents""")
def e15_word_counts(spark, sf_dir):
    """Words (E15), reading time (E16), tidied text (I30) and a clipped beginning (G05)."""
    t = F.col("text")
    n = F.size(X.words(t)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), X.audio_minutes(n, 1.2).alias("minutes"), F.md5(X.tidy(t)).alias("tidy"), X.clip(t).alias("clip"))


@query("""select o_orderkey, shown from (select o_orderkey, case o_orderkey % 4 when 0 then 'x^' || o_orderkey || '/2' when 1 then '(a+b)/' || o_orderkey when 2 then 'α≤β_' || o_orderkey else '{x}→ y' end as shown from orders)""")
def a31_wiki_formulas(spark, sf_dir):
    """Formula descriptions written as text."""
    i = F.col("o_orderkey")
    s = i.cast("string")
    made = (
        F.when(i % 4 == 0, F.concat(F.lit("{\\displaystyle x^{\\frac {"), s, F.lit("}{2}}}")))
        .when(i % 4 == 1, F.concat(F.lit("{\\textstyle \\frac{a+b}{"), s, F.lit("}}")))
        .when(i % 4 == 2, F.concat(F.lit("\\alpha\\leq\\beta_{"), s, F.lit("}")))
        .otherwise(F.lit("\\{x\\}\\to y"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", X.wiki_formula(made).alias("shown"))
