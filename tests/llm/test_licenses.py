from pagewright.llm import licenses as L


def test_a_match_holds_a_pivot():
    for text in L.TEMPLATES.values():
        found = L.shingles(L.template_words(text), 3)
        chosen = set(L.pivots(found, 0.8))
        assert sum(not chosen & set(s.split()) for s in found) < 0.8 * len(found)


def test_band_settings():
    assert L.miss_probability(48, 1, 1 / 3) < 1e-8
    for text in L.TEMPLATES.values():
        m = len(L.template_words(text))
        n = m - 2  # shingles; a window has 1.5 times the words
        window = m + -(-m // 2) - 2
        held = -(-8 * n // 10)
        assert held / (n + window - held) >= 1 / 3


def test_planted_notices(spark):
    filler = "the with that under some words "
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, filler * 50 + "Released under the MIT License. " + filler * 50),
        (2, filler * 7 + mit + "."),
        (3, filler + mit.replace("charge", "cost") + " " + filler),  # three of 18 shingles differ
        (4, filler + mit.replace("hereby granted, free of charge", "kindly given")),
        (5, "All rights\nreserved"),
        (6, "LICENSED UNDER CC BY-NC 4.0!"),
        (7, filler * 3000 + "licensed under the apache license, version 2.0 " + filler * 3000),
        (8, "under the license of that person"),
        (9, None),
        (10, ""),
        (1, filler * 50 + "Released under the MIT License. " + filler * 50),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, license string, words double")
    got = {(r.doc_id, r.license): r.containment for r in L.scan(docs).collect()}
    assert set(got) == {(1, "mit"), (2, "mit-permission"), (3, "mit-permission"), (5, "all-rights-reserved"), (6, "cc-by-nc-4.0"), (7, "apache-2.0")}
    assert got[2, "mit-permission"] == 1.0 and abs(got[3, "mit-permission"] - 15 / 18) < 1e-9
    assert L.scan(docs.limit(0)).collect() == []


def test_native(spark, small):
    plan = L.scan(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
