import numpy as np
import pytest
from pagewright.llm import language as L
from pagewright.llm.queries import QUERIES
from pyspark.sql import functions as F

TEXTS = {"aa": "kalo mino vapu tilo sanu", "bb": "strug bront flisk drunt klast", "cc": "xoqu zixy quaz jixe voxy"}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    found = QUERIES["op8_language_id"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.99
    assert found.where("score < 0 or score > 1").isEmpty()


@pytest.mark.parametrize("n", [2, 3, 5, 7, 8, 20])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    assert set(np.unique(code)) == {-1, 1} and len({tuple(c) for c in code}) == n
    assert all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))
    least = min((a != b).sum() for k, a in enumerate(code) for b in code[:k])
    assert least >= (code.shape[1] // 4 if n > 7 else (code.shape[1] + 1) // 2)


def many(n):
    return [(k, " ".join([t] * 5), lang) for k, (lang, t) in enumerate(x for x in TEXTS.items() for _ in range(n))]


def test_odd_rows(spark):
    rows = many(20) + [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, TEXTS["bb"], None), (None, TEXTS["aa"] * 2, "aa"), (904, TEXTS["cc"] * 40_000, "cc"), (0, "strug bront", "aa"), (0, "strug bront", "aa")]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, ambiguous boolean")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert (by[903].lang_pred, by[904].lang_pred, by[None].lang_pred) == ("bb", "cc", "aa")
    assert [r.lang_pred for r in got if r.doc_id == 0] == ["aa", "bb", "bb"] or sorted(r.lang_pred for r in got if r.doc_id == 0) == ["aa", "bb", "bb"]
    assert L.identify(docs.limit(0)).collect() == []


def test_few_languages(spark):
    docs = spark.createDataFrame(many(5), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit("aa"))).collect()} == {"aa"}


def test_ambiguous_texts():
    rows = []
    for lang, t in TEXTS.items():
        n = L.grams(" ".join([t] * 20))
        rows += [(lang, int(k), int(n[k])) for k in np.flatnonzero(n)]
    model = L.Model(rows)
    clear, mixed = model.predict([TEXTS["aa"], "q"])
    assert clear[0] == "aa" and not clear[2] and mixed[2]
    assert model.predict(["kalo mino", "strug bront"])[1][0] == "bb"


def test_long_texts_are_read_whole():
    assert (L.grams("ab " * 3_000_000) == L.grams("ab " * 3_000_000)).all()
    assert L.grams("ab " * 3_000_000).sum() == 9_000_000 - 1
