"""Pages, containers, books, streams and the command line."""

import io
import zipfile

import pytest
from pagewright import cli
from pagewright.functions import html as H
from pagewright.settings import PRESETS, Format
from pagewright.sinks import epub, export
from pagewright.sources import containers as C
from pagewright.sources import pages as P
from pagewright.streaming import ingest

PAGE = """<html lang="nl"><head><title>Foxes &amp; dens | News</title><meta property="og:title" content="Foxes"></head><body><nav><ul><li>Home</li></ul></nav>
<div class="share-box">Share!</div><article><h1>Foxes</h1><p>First <b>bold</b> and <i>italic</i> x<sup>2</sup>.<p>Second{fill}<ol start="3"><li>three<li>four</ol><blockquote>Said</blockquote>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table></article><aside role="doc-footnote">A note</aside><footer>x</footer></body></html>"""


def test_blocks():
    got = H.blocks(PAGE.replace("{fill}", ""))
    assert [(b.kind, b.text) for b in got] == [
        ("list_item", "• Home"), ("paragraph", "Share!"), ("heading", "Foxes"), ("paragraph", "First bold and italic x2."), ("paragraph", "Second"), ("list_item", "3. three"), ("list_item", "4. four"),
        ("quote", "Said"), ("table", ""), ("footnote", "A note"), ("paragraph", "x"),
    ]
    bold = got[3]
    assert [(bold.text[s:e], k) for s, e, k in bold.styles] == [("bold", "bold"), ("italic", "italic"), ("2", "superscript")]
    assert got[8].rows == [["a", "b"], ["1", ""]]


def test_article(spark):
    long = PAGE.replace("{fill}", " word, and more" * 30)
    title, lang, body = H.article(long)
    assert (title, lang) == ("Foxes", "nl") and "Share" not in body and "Home" not in body and "Second word" in body
    assert H.article("<p>short</p>") is None
    sections = "<div>" + "".join(f"<section><p>{'text, ' * 40}</p></section>" for _ in range(3)) + "</div><div><p>other words here that are short but long enough</p></div>"
    assert H.article(sections)[2].count("<section>") == 3
    rows = spark.createDataFrame([(1, "u", long), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    assert [r.title for r in P.articles(rows).collect()] == ["Foxes"]
    assert {r.page_id for r in P.blocks(rows).collect()} == {1}


def docx(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file():
    p = lambda text, style="", num="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{num}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    item = lambda text, depth: p(text, "", f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="5"/></w:numPr>')
    body = p("Main", "T") + p("Part", "H2") + item("one", 0) + item("in", 1) + item("two", 0) + item("in again", 1) + p("plain") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return docx(
        {
            "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        }
    )


def test_word_files():
    got = [(b.kind, b.text, b.level) for b in C.docx_blocks(word_file())]
    assert got == [("title", "Main", 0), ("heading", "Part", 2), ("list_item", "1. one", 0), ("list_item", "a) in", 1), ("list_item", "2. two", 0), ("list_item", "a) in again", 1), ("paragraph", "plain", 0), ("table", "", 0)]
    assert [C.marker("upperRoman", 14), C.marker("bullet", 3), C.roman(1994)] == ["XIV. ", "• ", "MCMXCIV"]


def test_list_counts(spark):
    rows = [("d", k, "l", depth) for k, depth in enumerate([0, 1, 1, 0, 1, 2, 1, 0])]
    got = C.list_markers(spark.createDataFrame(rows, "doc_id string, seq int, list string, depth int")).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.seq)] == [1, 1, 2, 2, 1, 1, 2, 3]


ITEMS = [("d", 0, "title", "Book & co", 0, ""), ("d", 1, "paragraph", "First.", 0, ""), ("d", 2, "heading", "One", 1, ""), ("d", 3, "heading", "Sub", 2, ""), ("d", 4, "table", "a\tb\nc\td", 0, ""), ("d", 5, "heading", "Two", 1, ""), ("d", 6, "quote", "Said *so*", 0, "")]


def test_books_can_be_read_back(spark):
    items = spark.createDataFrame(ITEMS, "doc_id string, seq int, kind string, text string, level int, marker string")
    book = export(items, "epub").first().content
    assert [(b.kind, b.text) for b in C.epub_blocks(bytes(book))] == [("heading", "Book & co"), ("paragraph", "First."), ("heading", "One"), ("heading", "Sub"), ("table", ""), ("heading", "Two"), ("quote", "Said *so*")]
    assert epub.pack([(0, "title", 0, "x")], "x") == epub.pack([(0, "title", 0, "x")], "x")
    text = export(items, "md").first().content
    assert text == "# Book & co\n\nFirst.\n\n## One\n\n### Sub\n\n| a | b |\n|---|---|\n| c | d |\n\n## Two\n\n> Said \\*so\\*\n"
    assert export(items, "txt").first().content.startswith("Book & co\n=========\n\nFirst.\n\nOne\n---\n\n")
    with pytest.raises(ValueError, match="unknown"):
        export(items, "pdf")


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.docx", b"\xd0\xcf\x11\xe0xxxx", "password"),
        ("a.epub", docx({"META-INF/rights.xml": "x"}), "Adobe DRM"),
        ("a.epub", docx({"META-INF/sinf.xml": "x"}), "Apple DRM"),
        ("a.epub", docx({"META-INF/encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></EncryptedData></e>'}), None),
        ("a.epub", docx({"META-INF/encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="x"/><CipherReference URI="c.xhtml"/></EncryptedData></e>'}), "DRM"),
        ("a.epub", docx({"META-INF/encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="x"/><CipherReference URI="f.otf"/></EncryptedData></e>'}), None),
        ("a.html", b"<p>x", None),
    ],
)
def test_locks(path, content, want):
    assert C.lock(path, content) == want


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(word_file())
    (tmp_path / "in/b.html").write_text(PAGE.replace("{fill}", ""))
    (tmp_path / "in/c.epub").write_bytes(b"no zip")
    (tmp_path / "in/d.docx").write_bytes(b"\xd0\xcf\x11\xe0")
    got = C.read_files(spark, f"file://{tmp_path}/in").collect()
    kinds = {(r.path.rpartition("/")[2], r.kind) for r in got}
    assert {("a.docx", "title"), ("b.html", "quote"), ("c.epub", "unreadable"), ("d.docx", "locked")} <= kinds
    assert cli.main([f"{tmp_path}/in", "-o", f"{tmp_path}/out", "-f", "md"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert cli.main([f"{tmp_path}/in", "-o", f"{tmp_path}/in/"]) == 2


def test_pages_of_blocks(spark):
    blocks = spark.createDataFrame([("d", 0, "The first block here"), ("d", 1, ""), ("d", 2, "Later on page three"), ("d", 3, "The first block here")], "doc_id string, seq int, text string")
    pages = spark.createDataFrame([("d", 0, "the FIRST block, here"), ("d", 1, "nothing"), ("d", 2, "Later on page three.")], "doc_id string, page long, text string")
    assert [r.page for r in sorted(C.place_on_pages(blocks, pages).collect(), key=lambda r: r.seq)] == [0, 0, 2, 2]


def test_streams(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    ingest.follow(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/check", lambda df, n: seen.extend(map(tuple, df.collect()))).awaitTermination()
    assert sorted(seen) == sorted(map(tuple, ingest.described(docs).collect()))


def test_settings():
    stored = PRESETS["Spacious"].with_(bold_amount="25").stored() | {"future": 1}
    assert Format.from_stored(stored) == PRESETS["Spacious"].with_(bold_amount="25")
