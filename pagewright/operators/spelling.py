"""Spelling by a lexicon table (word, freq), lower case.

Every test runs on distinct words, which meet the lexicon's words and all that is made of
them in an equi-join, so that neither side has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of words, pairs of spellings, what recognition confuses, short words.
PREFIXES = "non de un re pre anti counter over under post sub super inter multi semi co mis proto pseudo quasi neo hyper micro macro".split()
SUFFIXES = "s es ed ing er ers ly ness ism isms ist ists ity ities al ally ation ations ize izes ized izer izers ise ised able ment ments".split()
VARIANTS = [("ise", "ize"), ("isation", "ization"), ("ising", "izing"), ("ised", "ized"), ("yse", "yze"), ("our", "or"), ("tre", "ter"), ("ll", "l"), ("ogue", "og"), ("ence", "ense"), ("ae", "e"), ("oe", "e")]
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("l", "1"), ("0", "o"), ("o", "0"), ("5", "s"), ("8", "B"), ("cl", "d"), ("vv", "w"), ("ii", "u"),
    ("li", "h"), ("I", "l"), ("l", "I"), ("c", "e"), ("e", "c"), ("n", "u"), ("u", "n"), ("h", "b"), ("f", "t"), ("t", "f"), ("y", "v"), ("v", "y"), ("iy", "ry"), ("fi", "ﬁ"),
    ("|", "l"), ("!", "l"), ("€", "e"), ("é", "e"), ("tl", "d"), ("ri", "n"), ("in", "m"), ("j", "i"), ("i", "t"),
]
GLUE = {
    "en": "a an the to of in on at is it be by or as and for that with was are this from not but we he she they his its".split(),
    "nl": "de het een en van in is op te dat met voor niet die".split(),
    "de": "der die das und ist zu in den von mit ein eine auf im".split(),
    "fr": "le la les et de des est un une en du pour que dans".split(),
    "es": "el la los las y de en es un una que por con del".split(),
    "it": "il la di e in che un una per con del non le".split(),
    "pt": "o a os as de e em um uma que do da com por".split(),
}
STRAIGHT = ("’‘", "''")


def plain(word: Column) -> Column:
    return F.translate(F.lower(word), *STRAIGHT)


def _rules() -> list[tuple[str, str, str, int]]:
    """How a known word is made of a word of the lexicon: (put before, cut off the end, put behind, least length of the lexicon's word)."""
    out = [("", "", "", 0), ("", "", "'s", 0), ("", "s", "s'", 0)]
    out += [(p, "", "", max(4, 6 - len(p))) for p in PREFIXES]
    for s in SUFFIXES:
        least = max(4, 6 - len(s))  # of what is left without the suffix
        out += [("", "", s, least), ("", "e", s, least + 1), ("", "y", f"i{s}", least)]
    return out


def derived(lexicon: DataFrame) -> DataFrame:
    """(form): all words that are known by the lexicon: its own, their possessives, and what prefixes and suffixes make of them.

    A lexicon is far smaller than the words of a corpus, so its forms are spelled out rather than theirs.
    """
    rules = lexicon.sparkSession.createDataFrame(_rules(), "head string, cut string, tail string, least int")
    rows = lexicon.select("word").distinct().crossJoin(F.broadcast(rules))  # of a fixed number
    rows = rows.where((F.length("word") >= F.col("least")) & F.endswith("word", "cut"))
    form = F.concat("head", F.substring("word", F.lit(1), F.length("word") - F.length("cut")), "tail")
    return rows.select(form.alias("form")).distinct()


def known(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """The distinct ``column`` values of ``words`` that are known; ``lexicon`` may have been made into its forms by ``derived``."""
    asked = words.select(column).distinct().withColumn("form", plain(F.col(column)))
    return asked.join(lexicon if "form" in lexicon.columns else derived(lexicon), "form", "left_semi").select(column)


def replaced_once(word: Column, pairs: list[tuple[str, str]]) -> Column:
    """All words made by putting the second of a pair for the first, at one place."""
    out = []
    for x, y in pairs:
        n = F.length(word) - len(x) + 1
        at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), _stands(word, x))
        out.append(F.when(F.contains(word, F.lit(x)), F.transform(at, _put(word, x, y))).otherwise(F.expr("cast(array() as array<string>)")))
    return F.array_distinct(F.flatten(F.array(*out)))


def _stands(word: Column, x: str):
    return lambda i: F.substring(word, i, F.lit(len(x))) == x


def _put(word: Column, x: str, y: str):
    return lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(y), F.substring(word, i + len(x), F.length(word)))


def variants(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words of which another spelling (of either side of the sea) is known."""
    both = VARIANTS + [(b, a) for a, b in VARIANTS]
    rows = words.select("word").distinct().select("word", F.explode(replaced_once(F.lower("word"), both)).alias("other"))
    return rows.join(known(rows, lexicon, "other"), "other", "left_semi").select("word").distinct()


def run_together(words: DataFrame, lexicon: DataFrame, languages: tuple[str, ...] = ("en",), forms: DataFrame | None = None) -> DataFrame:
    """(word, split, glued): two known words run together; a short part must be a common word, and then both be common."""
    forms = derived(lexicon) if forms is None else forms
    glue = F.array(*map(F.lit, sorted({w for lang in languages for w in GLUE.get(lang, ())})))
    w = F.lower("word")
    rows = words.select("word").distinct().where(F.lower("word").rlike(r"^\p{L}{3,}$"))
    rows = rows.join(known(rows, forms), "word", "left_anti")
    rows = rows.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    rows = rows.select("word", "i", F.substring(w, F.lit(1), F.col("i")).alias("left"), F.substring(w, F.col("i") + 1, F.length("word")).alias("right"))
    short = lambda c: (F.length(c) > 2) | F.array_contains(glue, F.col(c))
    rows = rows.where(short("left") & short("right"))
    for side in ("left", "right"):
        rows = rows.join(known(rows, forms, side), side, "left_semi")
        freq = lexicon.groupBy(F.col("word").alias(side)).agg(F.max("freq").alias(f"f_{side}"))
        rows = rows.join(freq, side, "left")
    common = F.least(F.coalesce("f_left", F.lit(0.0)), F.coalesce("f_right", F.lit(0.0)))
    any_short = (F.length("left") <= 2) | (F.length("right") <= 2)
    glued = F.array_contains(glue, F.col("left")) | F.array_contains(glue, F.col("right"))
    rows = rows.withColumn("common", common).where(~any_short | (F.col("common") >= 1e-5)).withColumn("glued", glued)
    best = F.max_by(F.struct("left", "right", "glued"), F.struct("glued", "common", -F.col("i")))
    return rows.groupBy("word").agg(best.alias("b")).select("word", F.concat_ws(" ", "b.left", "b.right").alias("split"), "b.glued")


def _undone(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word, now), repeats included, with one more confusion undone: the pieces of ``now`` meet the list of pairs, which is sent to the tasks."""
    listed = rows.sparkSession.createDataFrame(pairs, "piece string, put string")
    rows = rows.select("word", "now", F.explode(F.array(*map(F.lit, sorted({len(x) for x, _ in pairs})))).alias("n")).where("length(now) >= n")
    rows = rows.select("word", "now", "n", F.explode(F.sequence(F.lit(1), F.length("now") - F.col("n") + 1)).alias("i"))
    met = rows.withColumn("piece", F.substring("now", F.col("i"), F.col("n"))).join(F.broadcast(listed), "piece")
    new = F.concat(F.substring("now", F.lit(1), F.col("i") - 1), F.col("put"), F.substring("now", F.col("i") + F.col("n"), F.length("now")))
    return met.select("word", F.lower(new).alias("now")).where("now <> word")


def _before(forms: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(form): every plain text that undoing one confusion may make one of the forms of."""
    listed = sorted({(x.lower(), y.lower()) for x, y in pairs})
    return forms.select(F.explode(replaced_once(F.col("form"), [(y, x) for x, y in listed])).alias("form")).distinct()


def confused(words: DataFrame, lexicon: DataFrame, rounds: int = 2, cost: float = 0.3) -> DataFrame:
    """(word, candidate, cost): known words that undoing up to ``rounds`` confusions of recognition gives.

    The texts from which a known form can still be reached are spelled out from the lexicon,
    a step for each round that is left. Of what a round makes only those go on, so that the
    ways of a corpus's words, most of which lead nowhere, are followed for one round only.
    """
    reach = [(lexicon if "form" in lexicon.columns else derived(lexicon)).select("form")]
    for _ in range(1, rounds):
        reach.append(reach[-1].unionByName(_before(reach[-1], CONFUSIONS)).distinct())
    now = words.select("word").distinct().select("word", F.col("word").alias("now"))
    found = None
    for k in range(1, rounds + 1):
        now = _undone(now, CONFUSIONS).withColumn("form", plain(F.col("now"))).join(reach[rounds - k].hint("merge"), "form", "left_semi").select("word", "now").distinct()
        part = now.withColumn("cost", F.lit(cost * k))
        found = part if found is None else found.unionAll(part)
    least = found.groupBy("word", F.col("now").alias("candidate")).agg(F.min("cost").alias("cost"))
    return least.join(known(least, lexicon, "candidate"), "candidate", "left_semi").select("word", "candidate", "cost")


def deletions(word: Column) -> Column:
    """The word and all words with one letter less."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def one_edit(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, candidate): lexicon words one insertion, deletion, replacement or swap away.

    Two such words share a form with at most one letter taken out, so they meet in an
    equi-join on those forms; what meets is then checked.
    """
    a = words.select(F.lower("word").alias("word")).distinct().select("word", F.explode(deletions(F.col("word"))).alias("form"))
    b = lexicon.select(F.col("word").alias("candidate")).distinct().select("candidate", F.explode(deletions(F.col("candidate"))).alias("form"))
    pairs = a.join(b, "form").where("word <> candidate").select("word", "candidate").distinct()
    w, c = F.col("word"), F.col("candidate")
    differ = F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.lit(1)) != F.substring(c, i, F.lit(1)))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swap = (F.length(w) == F.length(c)) & (F.size(differ) == 2) & (j == i + 1) & (F.substring(w, i, F.lit(1)) == F.substring(c, j, F.lit(1))) & (F.substring(w, j, F.lit(1)) == F.substring(c, i, F.lit(1)))
    return pairs.where((F.levenshtein(w, c) == 1) | swap)


def is_protected(token: Column, before: Column, count: Column, english: bool = True) -> Column:
    """Whether a token is left alone: short, a code, a name, an abbreviation, or used three times.

    ``before`` is the text before it, ``count`` how often the document has it.
    """
    letters = F.regexp_replace(token, "[^A-Za-zÀ-ɏ]", "")
    upper = (F.upper(token) == token) & (F.lower(token) != token)
    lead = F.rtrim(before)
    name = token.rlike(r"^\p{Lu}") & (lead != "") & ~lead.rlike("[.!?:“\"]$")
    accented = token.rlike("[À-ɏ]") if english else F.lit(False)
    code = token.rlike("[0-9]") & ~token.rlike("(?i)[a-z]{2}[0-9]|[0-9][a-z]{2}")
    return (
        (F.length(token) <= 2)
        | accented
        | (upper & (F.length(token) <= 6))
        | (token.rlike("[a-z][A-Z]") & ~token.rlike("[0-9|!]"))
        | code
        | (letters == "")
        | name
        | (count >= 3)
    )


# Ends of words that a line break cuts off, what a cut word may go on with, endings of inflection, short parts of compounds.
ENDINGS = (
    "tion", "tions", "sion", "sions", "ment", "ments", "ness", "ity", "ities", "ing", "ings", "ly", "ally", "ous", "ive", "ives", "ance", "ence", "ure", "ures", "ism", "ist",
    "ists", "able", "ible", "ical", "ated", "ation", "ations", "tive", "tial", "cial", "ture", "tures",
)
CUT_ENDINGS = ("e", "le", "ing", "ed", "es", "er", "ion", "ions", "ity", "al", "ly", "able", "ation", "ment")
INFLECTED = ("s", "es", "ed", "d", "ing", "ly", "er", "ers", "al", "ally", "ness", "ity", "ies", "ic", "ics")
SHORT_HEAD = ("a", "an", "to", "of", "in", "on", "at", "is", "it", "be", "by", "or", "as", "we")
SHORT_TAIL = ("to", "of", "in", "on", "at", "is", "it", "be", "by", "or", "as", "an", "we")
# How sure a suggestion is, and what a candidate's rank is made of.
GLUED_SURE, ONE_CONFUSION, TWO_CONFUSIONS, ONE_EDIT, FARTHER = 0.93, 0.97, 0.93, 0.85, 0.6
BY_FREQUENCY, BY_DOCUMENT, ANY_EDIT = 0.08, 0.35, 9.0


def misread(tokens: DataFrame, lexicon: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """The distinct ``word`` of tokens that are no known word, no word (word) of another language and no cut-off end."""
    words = tokens.select("word").distinct().where(~F.col("word").isin(*ENDINGS))
    words = words.join(known(words, lexicon), "word", "left_anti")
    if foreign is not None:
        other = words.join(foreign.select(F.col("word").alias("form")).distinct(), plain(F.col("word")) == F.col("form"), "left_semi").where(F.length("word") >= 4)
        words = words.join(other, "word", "left_anti")
    return words


def as_it_is(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words that are right though no lexicon has them: compounds, other spellings, contractions, cut or hyphenated words."""
    w, n = F.col("word"), F.length("word")
    asked = words.select("word").distinct()
    halves = asked.where(n >= 6).select("word", F.explode(F.sequence(F.lit(2), n - 2)).alias("i"))
    halves = halves.select("word", F.substring(w, F.lit(1), F.col("i")).alias("left"), F.substring(w, F.col("i") + 1, n).alias("right"))
    halves = halves.where(((F.length("left") > 2) | F.col("left").isin(*SHORT_HEAD)) & ((F.length("right") > 2) | F.col("right").isin(*SHORT_TAIL)))
    for side in ("left", "right"):
        halves = halves.join(known(halves, lexicon, side), side, "left_semi")
    cut = asked.where(n >= 4).select("word", F.explode(F.array(*(F.concat(w, F.lit(e)) for e in CUT_ENDINGS))).alias("longer"))
    cut = cut.join(known(cut, lexicon, "longer"), "longer", "left_semi")
    parts = asked.where(F.contains(w, F.lit("-"))).select("word", F.explode(F.split(w, "-")).alias("part"))
    odd = parts.where("part <> ''")
    odd = odd.join(known(odd, lexicon, "part"), "part", "left_anti")
    hyphened = parts.select("word").distinct().join(odd, "word", "left_anti")
    contracted = asked.where(w.rlike("[\\p{L}\\p{N}_]['’][\\p{L}\\p{N}_]") & ~w.rlike("[0-9|!]"))
    found = halves.select("word").unionByName(cut.select("word")).unionByName(hyphened.select("word")).unionByName(contracted)
    return found.unionByName(variants(asked, lexicon)).distinct()


def candidates(words: DataFrame, lexicon: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """(word, candidate, far, by_confusion, freq): what each word may have been, without its own inflections and parts."""
    edits = one_edit(words, lexicon).select("word", "candidate", F.lit(ANY_EDIT).alias("cost"))
    both = confused(words, lexicon if forms is None else forms).unionByName(edits).groupBy("word", "candidate").agg(F.min("cost").alias("cost")).where("word <> candidate")
    w, c = F.col("word"), F.col("candidate")
    longer, shorter = F.when(F.length(w) > F.length(c), w).otherwise(c), F.when(F.length(w) > F.length(c), c).otherwise(w)
    inflected = (F.length(w) != F.length(c)) & F.startswith(longer, shorter) & F.substring(longer, F.length(shorter) + 1, F.length(longer)).isin(*INFLECTED)
    possessive = F.contains(c, F.lit("'")) & ~F.contains(plain(w), F.lit("'"))
    part = F.startswith(c, w) | F.startswith(w, c) | F.endswith(c, w)
    far = F.least(F.col("cost"), F.levenshtein(w, c).cast("double"))
    both = both.where(~inflected & ~possessive & ~part & ((F.length(w) > 3) | (F.col("cost") < ANY_EDIT))).withColumn("far", far).where("far <= 2")
    freq = lexicon.groupBy(F.col("word").alias("candidate")).agg(F.max("freq").alias("freq"))
    return both.join(freq, "candidate", "left").select("word", "candidate", "far", (F.col("cost") < ANY_EDIT).alias("by_confusion"), F.coalesce("freq", F.lit(0.0)).alias("freq"))


def rated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The best candidate of each ``key``, with its confidence; ``rows`` are a token's candidates with ``in_doc``."""
    from pyspark.sql import Window as W

    score = F.col("far") - BY_FREQUENCY * F.log10(F.col("freq") * 1e6 + 1) - F.when(F.col("in_doc"), BY_DOCUMENT).otherwise(0.0)
    order = W.partitionBy(*key).orderBy("score", "far", "candidate")
    rows = rows.withColumn("score", score).withColumn("place", F.row_number().over(order)).withColumn("margin", F.lead("score").over(order) - F.col("score")).where("place = 1")
    far, n = F.col("far"), F.length("token")
    sure = F.when(F.col("by_confusion") & (far <= 0.3), ONE_CONFUSION).when(F.col("by_confusion") & (far <= 0.6), TWO_CONFUSIONS).when(far <= 1, ONE_EDIT).otherwise(FARTHER)
    sure = sure - F.when((far <= 1) & (n < 5), 0.1).otherwise(0.0)
    sure = F.when(n <= 3, F.least(sure, F.lit(0.75))).otherwise(sure)
    sure = sure - F.when(F.col("margin") < 0.15, 0.3).when(F.col("margin") < 0.5, 0.1).otherwise(0.0) + F.when(F.col("in_doc"), 0.03).otherwise(0.0)
    if "read" in rows.columns:  # how sure the recognition was, from 0 to 100
        sure = sure + F.when(F.col("read") > 90, -0.15).when((F.col("read") >= 0) & (F.col("read") < 60), 0.02).otherwise(0.0)
    return rows.withColumn("confidence", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), sure)), 2)).drop("place", "margin", "score")


def in_case_of(model: Column, word: Column) -> Column:
    """The word, in capitals as the model has them."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    return F.when((F.upper(model) == model) & (F.lower(model) != model), F.upper(word)).when(model.rlike(r"^\p{Lu}"), capital).otherwise(word)


def correction_status(confidence: Column, kind: Column, mode: str = "review", threshold: float = 0.9) -> Column:
    """"auto" from the threshold on, "pending" from 0.5 on if there is a review, else null; some kinds of blocks never."""
    out = F.when(kind.isin("furniture", "reference", "image", "table") | F.lit(mode == "disabled"), None).when(confidence >= threshold, "auto")
    return out.when((confidence >= 0.5) & F.lit(mode == "review"), "pending")


def lookups(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame, per_pos: int = 3) -> DataFrame:
    """(word, base, pos, rank, meaning): a word's senses under its first dictionary form that has any.

    ``lexicon`` has word, pos, rank and meaning, ``exceptions`` pos, word and base for
    irregular forms. An inflected form keeps the parts of speech that it can be.
    """
    w = F.regexp_replace(F.lower("word"), "'s$", "")
    rules = [F.struct(F.lit(-1).alias("rank"), F.lit("").alias("pos"), w.alias("base"))]
    for k, (pos, ending, put) in enumerate((p, e, b) for p, found in INFLECTIONS.items() for e, b in found):
        made = F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(put))
        rules.append(F.when(F.endswith(w, F.lit(ending)) & (F.length(w) > len(ending) + 1), F.struct(F.lit(2 * k + 2).alias("rank"), F.lit(pos).alias("pos"), made.alias("base"))))
    asked = words.select("word").distinct()
    by_rule = asked.select("word", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select("word", "r.rank", "r.pos", "r.base")
    order = F.create_map(*(x for k, p in enumerate("nvar") for x in (F.lit(p), F.lit(k))))
    odd = asked.join(exceptions.withColumnRenamed("word", "form"), F.regexp_replace(F.lower("word"), "'s$", "") == F.col("form")).select("word", F.element_at(order, F.col("pos")).alias("rank"), "pos", "base")
    forms_ = by_rule.unionByName(odd).groupBy("word", "base").agg(F.min("rank").alias("order"), F.collect_set("pos").alias("fits"))
    hits = forms_.join(lexicon.withColumnRenamed("word", "base"), "base")
    first = hits.groupBy("word").agg(F.min_by("base", F.struct("order", "base")).alias("base"))
    hits = hits.join(first, ["word", "base"], "left_semi")
    from pyspark.sql import Window as W

    fits = F.array_contains("fits", F.lit("")) | F.array_contains(F.col("fits"), F.col("pos"))
    any_fits = F.bool_or(fits).over(W.partitionBy("word"))
    hits = hits.withColumn("keep", fits | ~any_fits).where("keep")
    nth = F.row_number().over(W.partitionBy("word", "pos").orderBy("rank"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= per_pos).select("word", "base", "pos", F.col("nth").alias("rank"), "meaning")


# Endings of regular inflections and what stands for them in the base form.
INFLECTIONS = {
    "n": [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
