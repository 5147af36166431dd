"""Literal cases of operators, and plain versions of those that SQL can't express."""

import random

import pytest
from pagewright.external import Busy, Consent, answers, ask
from pagewright.functions import layout as L
from pagewright.functions.spelling import listed_mistakes
from pagewright.operators import corrections as K
from pagewright.operators import highlights as H
from pagewright.operators import pages as G
from pagewright.operators import structure as S
from pagewright.operators import tables as T
from pyspark.sql import functions as F

WORDS = """
    the a of to and with was for her his river garden library mountain weather journey harvest village market winter summer kettle carpenter bicycle analyse
    colour colours theatre orchard orchards green house workshop work shop flight office afflict final finger reflect file in to into rain bow rainbow window
    windows marine cook cooked baker keen bread table tables sail sails sailor
""".split()


def lexicon_of(spark, words=WORDS):
    return spark.createDataFrame([(w, 1e-4) for w in sorted(set(words))], "word string, freq double")


def suggested(spark, *texts, **how):
    """For each text, the suggestions by original."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [{} for _ in texts]
    for r in K.corrections(docs, lexicon_of(spark), **how).collect():
        out[r.doc_id][r.original] = (r.replacement, r.confidence)
    return out


def test_suggestions(spark):
    far = " " * 300
    left_alone = ["the analyze and color", "the greenhouse workshop", "the orchards’ was", "the analys", "the CPU3 was", "a harVest", "the it’ll", "in Wealher", "a winter-summer", "the gardcn gardcn gardcn", "the tion"]
    got, begun, named, *others = suggested(spark, "the wealher and the gardcn with a rnarket, the joumey ofthe villge", f"It ended.{far}Gardcn", f"with her{far}Gardcn", *left_alone)
    assert got["wealher"][0] == "weather" and got["gardcn"] == ("garden", 0.97) and got["rnarket"] == ("market", 0.97) and got["joumey"][0] == "journey"
    assert got["ofthe"] == ("of the", 0.93) and got["villge"] == ("village", 0.85)
    # a sentence may begin with a capital; after any white space, one in the middle of it is a name
    assert begun == {"Gardcn": ("Garden", 0.97)} and named == {}
    assert dict(zip(left_alone, others)) == dict.fromkeys(left_alone, {})


def test_own_and_foreign_words(spark):
    text = "the gardcn with her wintir villge and mountan"
    foreign = spark.createDataFrame([("wintir",)], "word string")
    read = spark.createDataFrame([(0, text.index("villge"), 95.0), (0, text.index("mountan"), 10.0)], "doc_id long, start int, read double")
    (got,) = suggested(spark, text, own=["Gardcn"], foreign=foreign, read=read)
    assert got == {"villge": ("village", 0.7), "mountan": ("mountain", 0.87)}


def test_split_words(spark):
    docs = spark.createDataFrame([(1, "the fl ight and refl ect with off ice, fi nal fin ger of fl"), (2, "mar ket in the vil lage t o the rain bow, a-win dow")], "doc_id long, text string")
    lexicon = lexicon_of(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    gaps = sorted((r.start, r.joined) for r in K.ligature_gaps(docs, lexicon).collect())
    assert [w for _, w in gaps] == ["flight", "reflect", "office", "final"]
    places = sorted((r.doc_id, r.start, r.joined, text[r.doc_id][r.start : r.end]) for r in K.split_places(docs, lexicon).collect() if r.doc_id == 2)
    assert [(w, was) for _, _, w, was in places] == [("market", "mar ket"), ("village", "vil lage"), ("to", "t o")]


def test_mistake_lists():
    assert listed_mistakes("Wea  ther and WEA THER, wea therx", [("wea ther", "weather"), ("and", "")]) == [(0, 9, "Weather"), (10, 13, ""), (14, 22, "WEATHER")]


def test_word_fixes(spark):
    lexicon = lexicon_of(spark)
    fixes = K.word_fixes(spark.createDataFrame([(1, "a fl ight tabel"), (2, None), (3, "")], "doc_id long, text string"), lexicon, [("tabel", "table")]).collect()
    assert sorted((r.replacement, r.source, r.original) for r in fixes) == [("flight", "ligature", "fl ight"), ("table", "list", "tabel")]
    places = K.split_places(spark.createDataFrame([(1, "mar ket vil lage")], "doc_id long, text string"), lexicon)
    taken = spark.createDataFrame([(1, 8, 10)], "doc_id long, start int, end int")
    said = spark.createDataFrame([(1, 0), (1, 8)], "doc_id long, start int")
    assert [r.replacement for r in K.joined_words(places, said, taken).collect()] == ["market"]


def cells(spark, rows, conf=None):
    made = [("d", "t", r, c, x, 1, float((conf or {}).get((r, c), -1))) for r, row in enumerate(rows) for c, x in enumerate(row)]
    return spark.createDataFrame(made, "doc_id string, table_id string, row int, col int, text string, header_rows int, min_conf double")


@pytest.mark.parametrize(
    ("rows", "conf", "want"),
    [
        # a letter for a digit, and a lost point
        ([["Town", "Rain", "Wind", "Days"], ["Ash", "61.4", "3.2", "l2"], ["Birch", "58.9", "4.1", "11"], ["Cedar", "602", "2.8", "14"], ["Dale", "63.3", "3.9", "10"]], {}, {(1, 3): "number", (3, 1): "number"}),
        ([["kg"], ["3.25"], ["412"], ["4.75"], ["5.5"]], {}, {(2, 0): "number"}),
        # decimals by a comma
        ([["kg"], ["7,4"], ["69"], ["8,1"], ["6,6"]], {}, {(2, 0): "number"}),
        # thousands, and words, are fine
        ([["Sold"], ["2,310"], ["845"], ["17,020"]], {}, {}),
        ([["Day"], ["cold"], ["wet"], ["dry"], ["l0"]], {}, {}),
        # what recognition was unsure of
        ([["Ra1n", "Sun"], ["4.1", "wet"]], {(0, 0): 35.0, (1, 1): 90.0}, {(0, 0): "unclear"}),
    ],
)
def test_doubtful_cells(spark, rows, conf, want):
    assert {(r.row, r.col): r.why for r in T.doubtful_cells(cells(spark, rows, conf)).collect()} == want


def test_table_text_round_trip(spark):
    before = cells(spark, [["a", "b"], ["c", "d"]])
    texts = T.as_text(before)
    changed = T.from_text(texts.withColumn("text", F.replace("text", F.lit("d"), F.lit("x y"))), before)
    assert {(r.row, r.col): r.text for r in changed.collect()} == {(0, 0): "a", (0, 1): "b", (1, 0): "c", (1, 1): "x y"}
    broken = T.from_text(texts.withColumn("text", F.lit("a\tb\tc")), before)
    assert {r.text for r in broken.collect()} == {"a", "b", "c", "d"}


def test_highlights_overwrite(spark):
    rows = spark.createDataFrame([("d", 1, 1, 3, "yellow", "one two three", "n")], "doc_id string, id int, start int, end int, colour string, words string, note string")
    new = spark.createDataFrame([("d", 2, 3, 5, "green", "three four five", "")], "doc_id string, id int, start int, end int, colour string, words string, note string")
    both = H.add(rows, new)
    left = H.erase(both, 2, 3)
    assert sorted((r.start, r.end, r.colour, r.note) for r in left.collect()) == [(1, 1, "yellow", "n"), (4, 5, "green", "")]
    over = H.add(rows, new.withColumn("start", F.lit(0)))
    assert [(r.start, r.end, r.note) for r in over.collect()] == [(0, 5, "n")]


def test_highlights_move_with_their_words(spark):
    words = spark.createDataFrame([("d", k, w) for k, w in enumerate("new words in front red fox".split())], "doc_id string, n int, text string")
    marks = spark.createDataFrame([("d", 1, 2, 3, "red fox"), ("d", 2, 0, 1, "no where")], "doc_id string, id int, start int, end int, words string")
    assert {r.id: r.at for r in H.resolve(marks, words).collect()} == {1: 4, 2: None}


PROSE = "some words of running prose text"


def columns(n=8):
    left = [(40.0, 100.0 + 12 * k, 290.0, 110.0 + 12 * k) for k in range(n)]
    right = [(300.0, 100.0 + 12 * k, 550.0, 110.0 + 12 * k) for k in range(n)]
    return left, right


def test_columns_are_read_one_after_the_other():
    left, right = columns()
    title, foot = (40.0, 50.0, 550.0, 70.0), (290.0, 400.0, 300.0, 408.0)
    boxes = [title, *left, *right, foot]
    mixed = list(range(len(boxes)))
    random.Random(1).shuffle(mixed)
    order = L.reading_order([boxes[i] for i in mixed])
    assert [mixed[i] for i in order] == list(range(len(boxes)))


def test_every_box_once():
    rng = random.Random(2)
    for _ in range(30):
        boxes = [(x, y, x + rng.uniform(5, 200), y + rng.uniform(5, 40)) for x, y in ((rng.uniform(0, 400), rng.uniform(0, 700)) for _ in range(rng.randint(0, 40)))]
        assert sorted(L.reading_order(boxes)) == list(range(len(boxes)))
        texts = ["some text" if rng.random() < 0.8 else None for _ in boxes]
        sizes, blocks = [rng.choice([9.0, 10.0, 14.0]) for _ in boxes], [rng.randint(0, 3) for _ in boxes]
        groups = L.pieces(boxes, texts, blocks, sizes)
        assert sorted(i for g in groups for i in g) == list(range(len(boxes)))
        assert sorted(L.column_order(groups, boxes, texts, sizes)) == list(range(len(groups)))
        assert sorted(L.untangle(boxes, texts, sizes, [""] * len(boxes), L.reading_order(boxes))) == list(range(len(boxes)))


def test_quotes_are_untangled():
    boxes, texts, sizes = [], [], []
    for k in range(3):
        boxes += [(40.0, 100.0 + 12 * k, 150.0, 110.0 + 12 * k), (160.0, 105.0 + 12 * k, 290.0, 115.0 + 12 * k)]
        texts += [f"text {k}", f"quote {k}"]
        sizes += [10.0, 14.0]
    boxes.append((40.0, 136.0, 290.0, 146.0))
    texts.append("ends here.")
    sizes.append(10.0)
    assert L.untangle(boxes, texts, sizes, [""] * 7, list(range(7))) == [0, 2, 4, 6, 1, 3, 5]


def test_pages_in_tasks(spark):
    left, right = columns()
    rows = [("d", 0, k, *b, f"line {k} {PROSE}", 10.0, False, 1 + (k >= 8), 3.0) for k, b in enumerate(left + right)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, block_no int, gap double")
    assert [r.seq for r in sorted(G.reading_order(lines).collect(), key=lambda r: r.place)] == list(range(16))
    assert len({r.piece for r in G.pieces(lines).collect()}) == 2
    assert {r.para for r in G.paragraphs(lines).collect()} <= {0, 1}
    assert S.interleaved(lines).first().mixed is False


def test_captions_and_outlines(spark):
    picture, tab = (40.0, 100.0, 300.0, 200.0), (40.0, 300.0, 300.0, 400.0)
    captions = [((40.0, 205.0, 300.0, 215.0), "Fig. 1. A"), ((40.0, 285.0, 300.0, 295.0), "Table 1: B"), ((40.0, 700.0, 300.0, 710.0), "Fig. 9. Far")]
    assert L.caption_targets(captions, [(picture, False), (tab, True)]) == [0, 1, None]
    assert L.similarity("abc", "abc") == 100 and L.similarity("abcd", "abxd") == 75
    assert L.headings_of_outline([(2, "The Methods", 2), (1, "Nothing", 1)], [(1, "The methods"), (2, "other text")]) == {0: 2}


def test_lines_are_joined():
    known = {"recognition", "well", "known"}.__contains__
    assert L.joined(["recogni-", "tion is well-", "known and soft­", "ened"], known) == "recognition is well-known and softened"


def test_requests_are_asked_again():
    calls, waits = [], []

    def busy(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise Busy("later")
        return "{}"

    assert ask(busy, "p", waits.append) == ("{}", ["later", "later"]) and waits == [2.0, 6.0]
    with pytest.raises(Busy):
        ask(lambda p: (_ for _ in ()).throw(Busy("no")), "p", waits.append)


def test_nothing_is_sent_without_consent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "request long, prompt string")
    for consent in (Consent(), Consent("ai_assisted"), Consent("ai_assisted", True)):
        with pytest.raises(PermissionError):
            answers(rows, lambda p: "{}", consent)
    got = {r.request: (r.answer, r.error is None) for r in answers(rows, lambda p: "{}" if p == "a" else "no json", Consent("ai_assisted", True, "k")).collect()}
    assert got == {1: ("{}", True), 2: (None, False)}


def test_tables_by_white_space():
    def line(k, *cells):
        words = [(x, x + 6.0 * len(w), w) for x, w in cells]
        return {"box": (words[0][0], 100.0 + 12 * k, words[-1][1], 110.0 + 12 * k), "size": 10.0, "words": words}

    rows = [line(0, (40.0, "Name"), (140.0, "Role"), (240.0, "Office")), line(1, (40.0, "Anna"), (140.0, "Editor"), (240.0, "2.14")), line(2, (40.0, "Bo"), (140.0, "Writer"), (240.0, "3.1"))]
    prose = line(4, (40.0, "just"), (70.0, "some"), (100.0, "prose"))
    (box, cells_), = L.gap_tables([*rows, prose])
    assert cells_ == [["Name", "Role", "Office"], ["Anna", "Editor", "2.14"], ["Bo", "Writer", "3.1"]] and box == (40.0, 100.0, 276.0, 134.0)
    assert L.gap_tables(rows[:2]) == []


def test_text_columns():
    text = "x" * 50
    lines = [(40.0 + 10 * (k % 4 == 0), 290.0, text) for k in range(8)] + [(300.0, 550.0, text) for _ in range(8)] + [(40.0, 60.0, "short")]
    assert L.text_columns(lines) == [(40.0, 290.0), (300.0, 550.0)]
