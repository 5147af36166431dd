"""Text functions over columns: words, sentences, keys, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, matches

# What a word is, and common short words by language, in the order in which ties are settled.
TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
STOPWORDS = {
    "en": "the and of to in is that for it with as was on are this".split(),
    "nl": "de het een en van in is dat op te zijn voor met niet die".split(),
    "de": "der die und das ist nicht mit den von zu ein eine auf".split(),
    "fr": "le la les et des est une dans que pour pas sur du".split(),
    "es": "el la los las y que es en una por para con del".split(),
    "it": "il lo gli le di che non per una sono della nel anche".split(),
    "pt": "os as um uma que não para com por dos das mais também".split(),
}
SAMPLE = 20_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_spans(text: Column) -> Column:
    return matches(text, TOKEN)


def words(text: Column) -> Column:
    """The runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def language(text: Column) -> Column:
    """The language with most common words among the first characters; English without any."""
    every = F.array(*(F.lit(w) for w in dict.fromkeys(w for ws in STOPWORDS.values() for w in ws)))
    lower = F.transform(tokens(F.substring(text, 1, SAMPLE)), lambda w: F.lower(w))

    def vote(found):
        scores = [
            F.struct(F.size(F.filter(found, _in(F.array(*map(F.lit, known))))).alias("n"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang"))
            for rank, (lang, known) in enumerate(STOPWORDS.items())
        ]
        return F.array_max(F.array(*scores))

    # only the common words, once, before each language looks for its own
    best = let(F.filter(lower, _in(every)), vote)
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit("en"))


def _in(held: Column):
    return lambda w: F.array_contains(held, w)


def furniture_key(text: Column) -> Column:
    """A running head without numbers and marks, its words in order, so that both sides of a spread agree."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s]|\p{Nd}", " ")
    key = F.array_join(F.array_sort(words(bare)), " ")
    return F.when(key == "", "0").otherwise(key)


def sentences(text: Column) -> Column:
    """The text's sentences: cut after . ! ? and white space."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


# What is masked, in this order, and the marks.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
LINK = r"(?i)(?:https?://|www\.)\S*[^\s.,;:)\]]"
ACCOUNT = r"(?<![\p{L}\p{N}_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}(?![\p{L}\p{N}_])"
YEARS = r"[0-9]{4}\s*[-/]\s*[0-9]{2,4}"
NUMBER = r"(?<![\p{L}\p{N}_.])(?!" + YEARS + r"(?![0-9 ./-]*[0-9]))\+?[0-9][0-9 ./-]{6,}[0-9](?![\p{L}\p{N}_.])"
KEY_SHAPES = (r"sk-ant-[A-Za-z0-9_\-]{8,}", r"AIza[0-9A-Za-z_\-]{20,}", r"mstrl_[A-Za-z0-9_\-]{8,}")
KEY_HEADERS = r"(?i)(?:x-api-key|x-goog-api-key|authorization)[\"']?\s*[:=]\s*[\"']?[^\s\"',}]+"


def mask(text: Column) -> Column:
    """Mail addresses, links, account-like and long numbers replaced by marks; year ranges stay."""
    for pattern, mark in ((EMAIL, "[email]"), (LINK, "[link]"), (ACCOUNT, "[account]"), (NUMBER, "[number]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact(text: Column, *secrets: str) -> Column:
    """Given secrets and whatever looks like a key replaced by a mark."""
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("[API key hidden]"))
    for pattern in (*KEY_SHAPES, KEY_HEADERS):
        text = F.regexp_replace(text, pattern, "[API key hidden]")
    return text


def bold_length(n: Column, amount: str = "auto") -> Column:
    """How many letters at a word's start are set bold."""
    if amount == "first_letter":
        out = F.lit(1)
    elif amount in ("25", "40"):
        out = F.greatest(F.lit(1), F.ceil(n * int(amount) / 100))
    else:
        out = F.when(n <= 3, 1).when(n <= 5, 2).otherwise(F.ceil(n * F.lit(0.4)))
    return F.when(n <= 0, 0).otherwise(out).cast("int")


# Words of letters, and chunks in which nothing is set bold.
LETTERS = r"\p{L}+(?:['’]\p{L}+)*"
PROTECTED = r"(?i:https?://|www\.|doi:)|\S+@\S+\.\w+|[_/\\]|[0-9]|[a-z]+[A-Z]\w*|\w+\.\w+\.\w+"


def bold_ranges(text: Column, amount: str = "auto") -> Column:
    """array<struct<start, end>>: the beginnings of words, but not in links, codes, numbers or capitals."""
    chunks = F.filter(matches(text, r"\S+"), lambda c: c["text"].rlike(PROTECTED))
    found = F.filter(
        matches(text, LETTERS),
        lambda w: ~F.exists(chunks, lambda c: (c["start"] <= w["start"]) & (w["start"] < c["end"])) & ~((F.upper(w["text"]) == w["text"]) & (F.length(w["text"]) > 1)),
    )
    return F.transform(found, lambda w: F.struct(w["start"].alias("start"), (w["start"] + bold_length(F.length(w["text"]), amount)).alias("end")))


def clean_word(word: Column) -> Column:
    """A word without what stands around it (and without soft hyphens)."""
    bare = F.replace(F.replace(word, F.lit("’"), F.lit("'")), F.lit("\u00ad"), F.lit(""))
    return F.regexp_replace(bare, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def lookup_url(word: Column, lang: Column) -> Column:
    code = F.when(lang.rlike("^[a-z]{2,3}$"), lang).otherwise(F.lit("en"))
    path = F.replace(F.url_encode(F.lower(clean_word(word))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://"), code, F.lit(".wiktionary.org/wiki/"), path)


def version(text: Column) -> Column:
    """The numbers of a version, or null."""
    found = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version ``a`` is above ``b``, missing parts counting as 0."""
    x, y = version(a), version(b)
    width = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), width - F.size(v)))
    return F.coalesce(pad(x) > pad(y), F.lit(False))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def window(text: Column, start: Column, end: Column, before: int = 8, after: int = 6) -> Column:
    """The item marked by double brackets, with some words on either side, masked."""
    head, tail = words(F.substring(text, F.lit(1), start)), words(F.substring(text, end + 1, F.length(text)))
    left = F.array_join(F.slice(head, F.greatest(F.size(head) - before, F.lit(0)) + 1, before), " ")
    right = F.array_join(F.slice(tail, 1, after), " ")
    left = F.when(F.size(head) > before, F.concat(F.lit("…"), left)).otherwise(left)
    right = F.when(F.size(tail) > after, F.concat(right, F.lit("…"))).otherwise(right)
    item = F.concat(F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"))
    return mask(F.array_join(F.filter(F.array(left, item, right), lambda p: p != ""), " "))


def clip(text: Column, limit: int = 220) -> Column:
    """The text up to ``limit`` characters, cut at a space, with an ellipsis."""
    head = F.substring(text, 1, limit)
    cut = limit - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (cut > 0), cut).otherwise(limit)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), cut.cast("int")), F.lit("…"))).otherwise(text)


def upper_heading(text: Column) -> Column:
    """At least four letters, all capital, and at most ten words."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    return (F.length(letters) >= 4) & (letters == F.upper(letters)) & ~letters.rlike(r"[^\p{Lu}]") & (F.size(words(text)) <= 10)


def title_case(text: Column) -> Column:
    """Most words of over three letters begin with a capital, in a line of 2 to 12 words."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ɏ][\p{L}\p{N}_'’-]*"), F.lit(0))
    long = F.filter(found, lambda w: F.length(w) > 3)
    capital = F.filter(long, lambda w: w.rlike(r"^\p{Lu}"))
    first = F.regexp_replace(text, r"^[\"'“‘(]+", "").rlike(r"^\p{Lu}")
    return F.size(found).between(2, 12) & first & (F.size(long) > 0) & (F.size(capital) / F.size(long) >= 0.75)


def garbled(text: Column) -> Column:
    """Many odd signs, a caret, or a run of over 22 letters."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'\"()–—‘’“”?!&/-]"))
    return (text == "") | (odd / F.length(text) > 0.04) | F.contains(text, F.lit("^")) | text.rlike("[A-Za-z]{23,}")


def font_family(name: Column) -> Column:
    bare = F.element_at(F.split(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), "[-,]"), 1)
    return F.lower(F.regexp_replace(bare, r"(?i)(bold|italic|oblique|regular|roman|medium|light|semibold|black|mt|ps)+$", ""))


# Classes of lines.
LINE_CLASSES = {
    "list_item": r"^\s*(?:[•‣◦⁃∙▪●○–—\-*·■►➢]|\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|\(?(?:i{1,3}|iv|v|vi{1,3}|ix|x)[.)])\s+",
    "numbered_heading": r"^(?:(?:[0-9]+\.)*[0-9]+\.?|[A-Z]\.|[IVX]{1,5}\.)\s+\S",
    "page_number": r"(?i)^(?:page\s*|pagina\s*|p\.\s*)?[-–(]?\s*[0-9]{1,4}\s*[-–)]?(?:\s*(?:of|/|van)\s*[0-9]{1,4})?$",
    "reference_heading": r"(?i)^\s*(?:[0-9]+\.?\s*)?(?:references|reference list|bibliography|works cited|literature cited|literature|sources|referenties|literatuur|literatuurlijst|bronnen|bronvermelding)\s*$",
    "special_heading": r"(?i)^\s*(?:abstract|samenvatting|summary|keywords|key words|trefwoorden|introduction|inleiding|conclusions?|conclusie|discussion|discussie|methods?|methode|results|resultaten|acknowledge?ments?|dankwoord|appendix|bijlage|contents|inhoud|inhoudsopgave|highlights|article info|graphical abstract)[\s:.]*$",
    "masthead": r"(?i)^(?:contents lists available at|journal homepage:|available online at|www\.sciencedirect\.com$|sciencedirect$)",
    "figure_doi": r"(?i)^(?:doi:\s?|https?://(?:dx\.)?doi\.org/)10\.\S+\.[gt][0-9]{3}$",
    "subsection": r"^[0-9]+(?:\.[0-9]+)+\.?\s+[A-Z]",
}
CAPTION = r"(?i)^\s*(?:fig\.?|figure|figuur|afb\.?|afbeelding|table|tab\.?|tabel|chart|graph|plate)\s*[0-9IVX]+[a-z]?(?:[^\p{L}\p{N}_]|$)"
CAPTION_IN_PROSE = r"^\s*(?i:fig\.?|figure|figuur|afb\.?|afbeelding|table|tab\.?|tabel|chart|graph|plate)\s*[0-9IVXivx]+[a-z]?\s*(?:[,;)]\s*|and\s|&\s|to\s|[-–]\s*[0-9])?\s*[a-z]"


def line_class(text: Column) -> Column:
    """The first class in LINE_CLASSES that fits, or null."""
    out = None
    for name, pattern in LINE_CLASSES.items():
        fits = text.rlike(pattern)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def is_caption(text: Column) -> Column:
    """A label with a number, unless prose goes on in lower case."""
    return text.rlike(CAPTION) & ~text.rlike(CAPTION_IN_PROSE)


def list_marker(text: Column) -> Column:
    """struct<marker, rest> of a list item; an empty marker for other text."""
    head = F.regexp_extract(text, f"({LINE_CLASSES['list_item']})", 1)
    return F.struct(F.trim(head).alias("marker"), F.substring(text, F.length(head) + 1, F.length(text)).alias("rest"))


def tidy(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def audio_minutes(n_words: Column, speed: float = 1.0, wpm: int = 165) -> Column:
    return n_words / F.lit(wpm * max(0.4, speed))


def wiki_formula(alt: Column) -> Column:
    """A formula's text from its description: the style wrapper goes, fractions are written with a slash."""
    out = F.regexp_replace(F.trim(alt), r"(?s)^\{\\(?:display|text)style\s*(.*)\}$", "$1")
    plain, group = r"\s*([\p{L}\p{N}_.]+)\s*", r"([^{}]*)"
    for _ in range(3):
        for a in (plain, group):
            for b in (plain, group):
                left, right = ("$1" if a is plain else "($1)"), ("$2" if b is plain else "($2)")
                out = F.regexp_replace(out, r"\\frac\s*\{" + a + r"\}\s*\{" + b + r"\}", f"{left}/{right}")
    for name, sign in WIKI_SYMBOLS.items():
        out = F.regexp_replace(out, rf"\\{name}(?![A-Za-z])", sign)
    out = F.replace(F.replace(out, F.lit("\\{"), F.lit("\x01")), F.lit("\\}"), F.lit("\x02"))
    return tidy(F.translate(F.regexp_replace(out, r"[{}]", ""), "\x01\x02", "{}"))


# Signs by name.
WIKI_SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π",
    "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "times": "×",
    "cdot": "·", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "sqrt": "√", "to": "→", "in": "∈",
    "sum": "Σ", "int": "∫", "ldots": "…", "circ": "°", "partial": "∂",
}
