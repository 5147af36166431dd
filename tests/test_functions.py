"""Literal cases of functions over columns."""

import unicodedata

import pytest
from pagewright.functions import citations as C
from pagewright.functions import overlay as O
from pagewright.functions import packing as P
from pagewright.functions import text as X
from pagewright.functions.formula import from_latex
from pagewright.sources.pages import wiki_api
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("wij gaan met de trein naar een stad die niet op het plan staat", "nl"),
        ("we were late for the train and this was not the first time", "en"),
        ("il treno per la città non è in orario e le persone sono stanche", "it"),
        ("o trem para a cidade não chegou com as malas que os amigos levaram", "pt"),
        ("qqq", "en"),
    ],
)
def test_language(spark, text, lang):
    assert one(spark, X.language(F.col("t")), t=text) == lang


def test_masking(spark):
    text = "Mail j.doe@uni.nl, see https://x.org/a?b=1, call +31 6 1234 5678, IBAN NL91ABNA0417164300, war (1914-1918) and (Smith, 2019), n = 42, 2019/20"
    out = one(spark, X.mask(F.col("t")), t=text)
    assert out == "Mail [email], see [link], call [number], IBAN [account], war (1914-1918) and (Smith, 2019), n = 42, 2019/20"


def test_window(spark):
    text = "one two three four five six seven eight nine ten (Kim, 2020) a b c d e f g h"
    at = text.index("(Kim")
    got = one(spark, X.window(F.col("t"), F.lit(at), F.lit(at + 11), 3, 2), t=text)
    assert got == "…eight nine ten [[(Kim, 2020)]] a b…"


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [
        ("shown before (Smith, 2020; Jones & Brown, 2021).", 0, [("author_date", ["Smith, 2020", "Jones & Brown, 2021"], 0.97)]),
        ("as shown [2, 5, 8] and [3–7] but x in [0, 1]", 10, [("numeric", ["2", "5", "8"], 0.97), ("numeric", ["3", "4", "5", "6", "7"], 0.97), ("numeric", ["0", "1"], 0.3)]),
        ("the interval (0, 2020) is large", 0, []),
        ("(N = 42, 2019 data)", 0, []),
        ("(see also van der Berg et al., 2010a, p. 5)", 0, [("author_date", ["see also van der Berg et al., 2010a, p. 5"], 0.97)]),
        ("[1-90]", 5, [("numeric", ["1", "90"], 0.4)]),
    ],
)
def test_citations(spark, text, n, want):
    got = one(spark, C.find(F.col("t"), F.lit(n)), t=text)
    assert [(c.kind, c["items"], c.confidence) for c in got] == want
    assert all(text[c.start : c.end] == c.text for c in got)


def test_raised_citations(spark):
    raised = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))
    got = one(spark, C.find(F.col("t"), F.lit(9), raised), t="text2,5 more")
    assert [(c.kind, c["items"], c.confidence) for c in got] == [("superscript", ["2", "5"], 0.9)]


def test_stripping(spark):
    assert one(spark, C.strip(F.col("t")), t="The results (Smith, 2019) hold [3] , see [Note 2]. ()") == "The results hold, see."


def test_bold_ranges(spark):
    text = "The quick fox, see https://x.org/a_b and camelCase v2.0 NASA."
    assert [text[r.start : r.end] for r in one(spark, X.bold_ranges(F.col("t")), t=text)] == ["T", "qu", "f", "s", "a"]
    assert [one(spark, X.bold_length(F.lit(7), a), t="") for a in ("first_letter", "40", "25", "auto")] == [1, 3, 2, 3]


def test_stale_corrections_are_skipped(spark):
    fix = lambda *v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("start", "end", "original", "replacement", "status", "source"), v)))
    fixes = F.array(fix(0, 3, "abc", "xyz", "accepted", "ai"), fix(4, 7, "def", "", "auto", "ai"), fix(4, 5, "d", "DD", "accepted", "user"))
    assert one(spark, O.apply(F.col("t"), fixes), t="abd def") == "abd DDef"


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [("the rnodel works", "the model works", (4, 10, "rnodel", "model")), ("same", "same", None), ("a b c", "a c", (2, 4, "b ", "")), ("one two", "one two three", (4, 7, "two", "two three")), ("x", "y", (0, 1, "x", "y"))],
)
def test_minimal_edits(spark, old, new, want):
    got = one(spark, O.minimal_edit(F.col("a"), F.col("b")), a=old, b=new)
    if want is None:
        assert got is None
    else:
        assert old[: got.start] + got.replacement + old[got.end :] == new and old[got.start : got.end] == got.original


@pytest.mark.parametrize(("words", "want"), [(["Hi", "e.g.", "this.", "Next"], [0, 0, 0, 1]), (["A.", "B", "ends!", "go"], [0, 0, 0, 0]), (["List:", "One", "two."], [0, 1, 1])])
def test_sentences_of_words(spark, words, want):
    assert one(spark, P.units(P.ends(F.split("t", " "))), t=" ".join(words)) == want


def test_parts(spark):
    assert one(spark, P.parts(F.array(*map(F.lit, (900, 900, 1, 5000, 10))), 1800), t="") == [0, 0, 1, 2, 3]
    words = " ".join(["w"] * 9 + ["end."] + ["w"] * 10)
    assert one(spark, P.summary_parts(F.split("t", " "), 12), t=words) == [0, 10]


@pytest.mark.parametrize(("a", "b", "newer"), [("v1.14.10", "1.14.9", True), ("1.2", "1.2.0", False), ("x", "1", False), ("2", "1.9.9", True)])
def test_versions(spark, a, b, newer):
    assert one(spark, X.is_newer(F.col("a"), F.col("b")), a=a, b=b) is newer


@pytest.mark.parametrize(("text", "caption"), [("Fig. 4. Growth", True), ("Fig. 4 shows growth", False), ("Table 2: Means", True), ("Figures", False), ("Fig. 2 and 3 show", False)])
def test_captions(spark, text, caption):
    assert one(spark, X.is_caption(F.col("t")), t=text) is caption


def test_wiki_pages(spark):
    got = one(spark, wiki_api(F.col("t")), t="https://en.m.wikipedia.org/wiki/Red%20fox?x=1")
    assert got == "https://en.wikipedia.org/w/rest.php/v1/page/Red_fox/html"
    assert one(spark, wiki_api(F.col("t")), t="https://example.org/wiki/x") is None


@pytest.mark.parametrize(
    ("typed", "text"),
    [
        (r"\frac{m v^2}{2}", "(m v²)/2"),
        (r"$\frac12 + \frac{x}{y}$", "1/2 + x/y"),
        (r"\sqrt[3]{8} = \sqrt 4", "∛8 = √4"),
        (r"\prod_{k=1}^{m} a_k", "∏ₖ₌₁ᵐ aₖ"),
        (r"y''_0 - z_{max}^{2}", "y₀′′ − zₘₐₓ²"),
        (r"a_i^{q+Q}", "aᵢ^(q+Q)"),
        (r"\cos \theta \le \tan\alpha", "cos θ ≤ tan α"),
        (r"\text{if } p \in \mathbb{Q}, \mathrm{d}t", "if p ∈ ℚ, dt"),
        (r"\begin{bmatrix} a & 0 \\ 0 & b \end{bmatrix} \not= \binom{n}{k}", "[matrix(a, 0; 0, b)] ≠ C(n, k)"),
        (r"\left( \vec{v} \right) \cdot \widehat{pq}", "( v⃗) · hat(pq)"),
        (r"\begin{aligned} u &= 1 \\ v &= 2 \end{aligned}", "u = 1; v = 2"),
    ],
)
def test_formulas(typed, text):
    made = from_latex(typed)
    assert (made.text, made.unknown, made.balanced) == (unicodedata.normalize("NFC", text), [], True)


def test_nothing_typed_is_lost():
    made = from_latex(r"\gizmo{u+v}{w} \ne 5")
    assert (made.text, made.unknown) == (r"\gizmo{u+v}{w} ≠ 5", [r"\gizmo"])
    assert from_latex(r"\begin{puzzle} x \end{puzzle}").unknown == [r"\begin{puzzle}"]
    for typed in (r"\sqrt{3", "3}", "}{"):
        assert not from_latex(typed).balanced
    assert from_latex("{" * 5000 + "x" + "}" * 5000).text == "x"
