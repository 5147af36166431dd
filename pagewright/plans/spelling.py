"""Queries of spelling. The lexicon is the benchmark's words with their frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spelling as S
from ..operators.blocks import table
from .registry import query

_LEX = r"lex as materialized (select word, count(*)::double / (select count(*) from benchmark) as freq from (select lower(unnest(regexp_extract_all(text, '\p{L}+'))) as word from benchmark) group by word)"
_PRE = ", ".join(f"('{p}')" for p in S.PREFIXES)
_SUF = ", ".join(f"('{s}')" for s in S.SUFFIXES)


def _known(rel: str, col: str) -> str:
    """SQL for the known ones of a relation's column: by itself, as possessive, by prefix or by suffix.

    The words are cut off at each of a few lengths, and the ends that were cut off, or what is left, meet lists in equi-joins.
    """
    w = f"replace(replace(lower({col}), '’', ''''), '‘', '''')"
    heads, tails = sorted({len(p) for p in S.PREFIXES}), sorted({len(s) for s in S.SUFFIXES})
    return f"""(with asked as materialized (select distinct {col} as was, {w} as w from {rel}),
  cut as materialized (select was, w, unnest({heads}) as n from asked where length(w) >= 6),
  ended as materialized (select was, w, unnest({tails}) as n from asked where length(w) >= 6),
  stems as materialized (select was, substr(w, 1, length(w) - n) as stem from ended join (values {_SUF}) suf(s) on right(w, n) = s where length(w) - n >= 4 and length(s) = n),
  forms as (select was, w as form from asked union all select was, substr(w, 1, length(w) - 2) from asked where w like '%''s' union all select was, substr(w, 1, length(w) - 1) from asked where w like '%s'''
    union all select was, substr(w, n + 1) from cut join (values {_PRE}) pre(p) on substr(w, 1, n) = p where length(w) - n >= 4 and length(p) = n
    union all select was, stem from stems union all select was, stem || 'e' from stems union all select was, substr(stem, 1, length(stem) - 1) || 'y' from stems where ends_with(stem, 'i'))
  select distinct was from forms join lex on form = word)"""


_TOKENS = r"tokens as materialized (select distinct lower(unnest(regexp_extract_all(text, '[\p{L}]+'))) as word from documents)"


def _lexicon(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    words = bench.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return words.crossJoin(bench.agg(F.count("*").alias("items"))).select("word", (F.col("n") / F.col("items")).alias("freq"))


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()


@query(f"with {_LEX}, {_TOKENS}, hits as materialized {_known('tokens', 'word')} select t.word, h.was is not null as known from tokens t left join hits h on t.word = h.was")
def c10_known_words(spark, sf_dir):
    """Which of the documents' words are known, by themselves or by their parts (C11)."""
    words = _tokens(spark, sf_dir)
    hits = S.known(words, _lexicon(spark, sf_dir)).withColumn("known", F.lit(True))
    return words.join(hits, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


_PAIRS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in S.VARIANTS)


@query(f"""with {_LEX}, {_TOKENS}, made as (select distinct word, substr(word, 1, i - 1) || y || substr(word, i + length(x)) as other from (select word, x, y, unnest(generate_series(1, length(word) - length(x) + 1)) as i from tokens, (values {_PAIRS}) v(x, y) where length(word) >= length(x)) where substr(word, i, length(x)) = x)
select distinct word from made where other in {_known('made', 'other')}""")
def c13_spelling_variants(spark, sf_dir):
    """Words of which another spelling is known."""
    return S.variants(_tokens(spark, sf_dir), _lexicon(spark, sf_dir))


_GLUE = ", ".join(f"'{g}'" for g in S.GLUE["en"])


@query(f"""with {_LEX}, {_TOKENS}, t as (select word from tokens where length(word) >= 3 and word not in {_known('tokens', 'word')}),
cuts as (select word, i, substr(word, 1, i) as l, substr(word, i + 1) as r from (select word, unnest(generate_series(1, length(word) - 1)) as i from t)),
ok as (select * from cuts where (length(l) > 2 or l in ({_GLUE})) and (length(r) > 2 or r in ({_GLUE})) and l in {_known('cuts', 'l')} and r in {_known('cuts', 'r')}),
f as (select ok.*, least(coalesce(a.freq, 0), coalesce(b.freq, 0)) as common, l in ({_GLUE}) or r in ({_GLUE}) as glued from ok left join lex a on a.word = l left join lex b on b.word = r)
select word, arg_max(l || ' ' || r, [glued::int::double, common, -i]) as split, bool_or(glued) as glued from f where (length(l) > 2 and length(r) > 2) or common >= 1e-5 group by word""")
def i11_run_together(spark, sf_dir):
    """Words that are two known words run together."""
    return S.run_together(_tokens(spark, sf_dir), _lexicon(spark, sf_dir))


_CONF = ", ".join(f"('{a}', '{b}')" for a, b in S.CONFUSIONS)


def _confuse(rel, col):
    """Words of a relation's column with one confusion undone: the pieces of a word that may be confused meet the list in an equi-join."""
    sizes = sorted({len(a) for a, _ in S.CONFUSIONS})
    return f"""(select distinct word, lower(substr(c, 1, i - 1) || y || substr(c, i + n)) as c from (
    select word, c, n, i, substr(c, i, n) as piece from (select word, c, n, unnest(generate_series(1, length(c) - n + 1)) as i from (select word, {col} as c, unnest({sizes}) as n from {rel}) where length(c) >= n))
  join (values {_CONF}) v(x, y) on piece = x)"""


@query(f"""with {_LEX}, {_TOKENS}, one as materialized (select word, c from {_confuse('tokens', 'word')} where c <> word), two as materialized (select word, c from {_confuse('one', 'c')} where c <> word),
least_ as materialized (select word, c, min(cost) as cost from (select word, c, 0.3::double as cost from one union all select word, c, 0.6::double from two) group by all),
words_ as materialized (select distinct c from least_), hits as materialized {_known('words_', 'c')}
select word, c as candidate, cost from least_ join hits on c = was""")
def i12_confused_words(spark, sf_dir):
    """Known words that undoing two confusions of recognition gives."""
    return S.confused(_tokens(spark, sf_dir), _lexicon(spark, sf_dir))


@query("""with lex as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from benchmark), tokens as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents),
p as (select t.word, l.word as candidate from tokens t, lex l where abs(length(t.word) - length(l.word)) <= 1 and t.word <> l.word)
select word, candidate from p where levenshtein(word, candidate) = 1 or (length(word) = length(candidate) and damerau_levenshtein(word, candidate) = 1)""")
def i13_one_edit_away(spark, sf_dir):
    """Lexicon words one edit away (runs of ASCII letters, where both engines count alike)."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return S.one_edit(words("documents"), words("benchmark"))


@query(r"""with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (['ab', 'café', 'NASA', 'camelCase', 'x12', 'informati0n', 'Paris', 'word'])[l_partkey % 8 + 1] as token, (['', 'Ends here. ', 'in the '])[l_suppkey % 3 + 1] as before, l_linenumber as n from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (length(token) <= 2 or regexp_matches(token, '[À-ɏ]') or (upper(token) = token and length(token) <= 6) or (regexp_matches(token, '[a-z][A-Z]') and not regexp_matches(token, '[0-9|!]'))
  or (regexp_matches(token, '[0-9]') and not regexp_matches(token, '(?i)[a-z]{2}[0-9]|[0-9][a-z]{2}')) or (regexp_matches(token, '^[A-Z]') and trim(before) <> '' and not regexp_matches(trim(before), '[.!?:“"]$')) or n >= 3) as protected from t""")
def c14_protected_tokens(spark, sf_dir):
    """Tokens that are never corrected."""
    pick = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), F.expr(f"cast({e} as int)"))
    token = pick(("ab", "café", "NASA", "camelCase", "x12", "informati0n", "Paris", "word"), "l_partkey % 8 + 1")
    before = pick(("", "Ends here. ", "in the "), "l_suppkey % 3 + 1")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.is_protected(token, before, F.col("l_linenumber")).alias("protected"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_linenumber % 5 = 0 then null when l_discount * 10 >= 0.9 then 'auto' when l_discount * 10 >= 0.5 then 'pending' end as status from lineitem""")
def i15_correction_status(spark, sf_dir):
    """What becomes of corrections by their confidence."""
    kind = F.when(F.col("l_linenumber") % 5 == 0, "table").otherwise("paragraph")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.correction_status(F.col("l_discount") * 10, kind).alias("status"))
