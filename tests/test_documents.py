"""Composed documents, structure fixes, and places in texts."""

import pytest
from pagewright.functions import passages as Q
from pagewright.operators import document as D
from pagewright.settings import Format
from pagewright.sinks import export
from pyspark.sql import functions as F

BLOCK = (
    "doc_id string, block_id string, seq int, kind string, text string, level int, page int, font_size double, footnote_label string,"
    " fixes array<struct<start int, end int, original string, replacement string, status string, source string>>,"
    " styles array<struct<start int, end int, bold boolean, italic boolean, superscript boolean, subscript boolean, math boolean>>"
)


def block(seq, kind, text, level=0, page=0, size=10.0, label=None, fixes=(), raised=()):
    styles = [(s, e, False, False, True, False, False) for s, e in raised]
    return ("d", f"b{seq}", seq, kind, text, level, page, size, label, list(fixes), styles)


@pytest.fixture
def blocks(spark):
    return spark.createDataFrame(
        [
            block(0, "furniture", "Journal 3"),
            block(1, "title", "The title"),
            block(2, "heading", "Abstract", 1),
            block(3, "paragraph", "Short rnodel here.", fixes=[(6, 12, "rnodel", "model", "auto", "dictionary")]),
            block(4, "heading", "1 Intro", 1),
            block(5, "paragraph", "As shown (Smith, 2020; Nobody, 2001) and2 again (see Smith, 2020).", raised=[(40, 41)]),
            block(6, "footnote", "1 First note.", size=8.0, label="1"),
            block(7, "footnote", "2 Second note.", size=8.0, label="2"),
            block(8, "paragraph", "tiny print", size=7.0),
            block(9, "list_item", "a) item one"),
            block(10, "heading", "References", 1),
            block(11, "reference", "Smith, J. (2020). Typography."),
        ],
        BLOCK,
    )


def test_compose(blocks):
    items = D.compose(blocks, Format(move_citations=True))
    got = [(r.kind, r.marker, r.text) for r in sorted(items.collect(), key=lambda r: r.seq)]
    assert got == [
        ("title", "", "The title"),
        ("box_heading", "", "Abstract"),
        ("box_paragraph", "", "Short model here."),
        ("heading", "", "1 Intro"),
        ("paragraph", "", "As shown [1][2] and [Note 1] again [1]."),
        ("small", "", "tiny print"),
        ("list_item", "a)", "item one"),
        ("heading", "", "References"),
        ("reference", "", "Smith, J. (2020). Typography."),
        ("heading", "", "Notes"),
        ("endnote", "[Note 1]", "Second note."),
        ("endnote", "[Note 2]", "First note."),
        ("heading", "", "Citations not matched to the reference list"),
        ("endnote", "[2]", "Nobody, 2001."),
    ]
    assert "## Notes\n\n[Note 1] Second note." in export(items, "md").first().content


def test_compose_leaves_what_is_not_asked_for(blocks):
    got = {r.text for r in D.compose(blocks, Format(remove_headers_footers=False, move_footnotes=False)).collect()}
    assert {"Journal 3", "1 First note.", "As shown (Smith, 2020; Nobody, 2001) and2 again (see Smith, 2020)."} <= got


def test_structure_fixes(spark, blocks):
    fixes = spark.createDataFrame([("d", "b5", "heading", 8, 2), ("d", "b4", "not_heading", 7, 0), ("d", "b8", "furniture", 10, 0)], "doc_id string, block_id string, fix string, end int, level int")
    got = [(r.block_id, r.kind, r.text[:12]) for r in sorted(D.view(blocks, fixes).where("seq between 4 and 8").collect(), key=lambda r: (r.seq, r.part))]
    assert got == [("b4", "paragraph", "1 Intro"), ("b5~h", "heading", "As shown"), ("b5", "paragraph", "(Smith, 2020"), ("b6", "footnote", "1 First note"), ("b7", "footnote", "2 Second not"), ("b8", "furniture", "tiny print")]


def test_findings_and_widths(spark):
    schema = "doc_id string, correction_id string, start int, end int, original string, replacement string, status string, source string"
    have = spark.createDataFrame([("d", "u1", 0, 5, "a", "b", "accepted", "user")], schema)
    found = spark.createDataFrame([("d", "f1", 3, 8, "x", "y"), ("d", "f2", 10, 12, "p", "q")], "doc_id string, id string, start int, end int, original string, replacement string")
    both = D.apply_finding(have, found)
    assert sorted(r.correction_id for r in both.collect()) == ["check-f2", "u1"]
    assert [r.correction_id for r in D.undo_finding(both, found).collect()] == ["u1"]
    widths = spark.createDataFrame([(0.0,), (0.05,), (0.33333,), (7.0,)], "w double").select(D.picture_width(F.col("w")).alias("x"))
    assert [r.x for r in widths.collect()] == [None, 0.2, 0.333, 1.0]
    rows = spark.createDataFrame([("d", '[{"start": 1, "end": 2, "colour": "green"}, {"start": "?"}]'), ("e", "broken")], "doc_id string, json string")
    assert [tuple(r) for r in D.stored_highlights(rows).collect()] == [("d", 1, 2, "green", "", "")]


def test_places():
    text = "Intro sentence here. Smith et al. showed that the rnodel works, e.g. in tests. Next one!"
    at = text.index("rnodel")
    s, e = Q.sentence_around(text, at, at + 6)
    assert text[s:e] == "Smith et al. showed that the rnodel works, e.g. in tests."
    assert Q.locate("a  b\nc", "a b c") == (0, 6) and Q.locate("abc", "x") is None and Q.locate("abc", " ") is None
    blocks = [("b1", "nothing", []), ("b2", "the rnodel con-\ntinues", [(4, 10, "model")])]
    assert Q.find_passage("the model", blocks) == ("b2", 0, 10)
    assert Q.find_passage("ﬁnd", [("b", "we find it", [])]) == ("b", 3, 7)
    assert Q.find_passage("gone", blocks) is None
    assert Q.with_word_breaks("forthe win", ["for", "the", "win"]) == "for the win" and Q.with_word_breaks("x", ["y"]) == "x"
