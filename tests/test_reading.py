"""Reading aloud and findings."""

from pagewright.operators import reading as R


def test_sentences_of_pages(spark):
    words = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 1, 1), ("d", 2, 3)], "doc_id string, sentence int, page int")
    pages = spark.createDataFrame([("d", p) for p in range(6)], "doc_id string, page int")
    assert {r.page: r.sentence for r in R.first_sentence_on(words, pages).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2}


def test_pages_and_spans(spark):
    blocks = spark.createDataFrame([("d", 0), ("d", 1), ("d", 9)], "doc_id string, page int")
    info = spark.createDataFrame([("d", 0, 4), ("d", 1, -1)], "doc_id string, page int, source_page int")
    assert sorted((r.page, r.source) for r in R.source_pages(blocks, info).collect()) == [(0, 5), (1, 2), (9, 10)]
    spans = spark.createDataFrame([("d", 0, 3), ("d", 5, 6)], "doc_id string, start int, end int")
    places = spark.createDataFrame([("d", 2), ("d", 4)], "doc_id string, n int")
    assert sorted(tuple(r) for r in R.span_at(places, spans).collect()) == [("d", 2, 0, 3), ("d", 4, 4, 4)]


def test_kept_words(spark):
    words = spark.createDataFrame([("d", 0, 0, "It", 0, 2), ("d", 0, 1, "(Smith,", 3, 10), ("d", 0, 2, "2019)", 11, 16), ("d", 0, 3, "holds.", 17, 23)], "doc_id string, sentence int, k int, text string, start int, end int")
    cited = spark.createDataFrame([("d", 0, 3, 16)], "doc_id string, sentence int, start int, end int")
    assert sorted((r.text, r.at) for r in R.kept_words(words, cited).collect()) == [("It", 0), ("holds.", 3)]


def test_findings_must_quote_their_block(spark):
    answers = spark.createDataFrame([("d", 0, 1, "Word ", "num  ber"), ("d", 0, 1, "word", "num ber"), ("d", 0, 1, "word", "absent"), ("d", 0, 7, "word", "x"), ("d", 0, 1, "style", "num")], "doc_id string, part int, b int, t string, q string")
    blocks = spark.createDataFrame([("d", 0, 1, "The num\nber of")], "doc_id string, part int, b int, text string")
    assert [(r.t, r.q, r.start) for r in R.held_findings(answers, blocks).collect()] == [("word", "num ber", 4)]
