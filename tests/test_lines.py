"""From placed lines to blocks, by a made-up paper of two pages."""

from pagewright.operators import lines as L
from pagewright.operators import stores as K

PAGES = [
    [(60, 18, True, "Rivers of the north"), (100, 10, False, "Rivers begin in the hills and they run"), (113, 10, False, "down to the sea, where the water is"), (126, 10, False, "salt. Towns stand where the ships"), (710, 8, False, "1 A note about towns.")],
    [(100, 10, False, "could come in from the sea and trade."), (140, 13, True, "Methods"), (165, 10, False, "We walked along all of the rivers."), (710, 8, False, "2 Another note at the foot.")],
]


def placed(spark):
    rows, seq = [], 0
    for page, found in enumerate(PAGES):
        for y, size, bold, text in found:
            rows.append(("d", page, seq, text, 60.0, float(y), 60.0 + 5.0 * len(text), float(y + size), float(size), bold, text[0].isdigit(), 800.0, "", 0))
            seq += 1
    return spark.createDataFrame(rows, "doc_id string, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, raised boolean, height double, font string, block_no int")


def test_structure_of_a_document(spark):
    found = [(r.kind, r.text) for r in sorted(L.detect(placed(spark)).collect(), key=lambda r: r.seq)]
    assert found == [
        ("title", "Rivers of the north"),
        ("paragraph", "Rivers begin in the hills and they run down to the sea, where the water is salt. Towns stand where the ships could come in from the sea and trade."),
        ("footnote", "1 A note about towns."),
        ("heading", "Methods"),
        ("paragraph", "We walked along all of the rivers."),
        ("footnote", "2 Another note at the foot."),
    ]


def test_session_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><body><h1>The garden</h1><p>The cat is in the garden and it is not on the roof.</p></body></html>")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    made = K.session(spark, str(tmp_path))
    assert [(r.kind, r.text) for r in made["blocks"].orderBy("seq").collect()][0] == ("heading", "The garden")
    assert [r.kind for r in made["refused"].collect()] == ["unreadable"]
    assert [(r.lang, r.title) for r in made["defaults"].collect()] == [("en", "The garden")]
    assert [r.lang for r in K.session(spark, str(tmp_path), "nl")["defaults"].collect()] == ["nl"]
