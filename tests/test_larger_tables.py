"""Queries whose made-up keys grow with the tables, against their SQL on larger tables."""

import compare
from pagewright.plans import oracles, queries


def test_popups_name_every_number(spark):
    larger, name = "/root/testdata/sf0.01", "d15_popups"
    found = queries.QUERIES[name](spark, larger)
    sql = compare.connect(larger).execute(oracles.ORACLES[name])
    got = compare.rows_of(found.columns, found.collect())
    want = compare.rows_of([c[0] for c in sql.description], sql.fetchall())
    missing = len(set(want) - set(got))
    assert (len(got), missing) == (len(want), 0)


def test_notes_are_not_broadcast(spark, small):
    """Notes made by exploding look small to the planner, but not to the driver that gathers them."""
    found = queries.QUERIES["d02_footnotes_of_markers"](spark, small)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_ranges_are_not_cut_into_buckets(spark):
    import random

    from pagewright.operators import links

    rng = random.Random(5)
    ranges = [(rng.choice(["a", "b", None]), s := rng.randrange(60), s + rng.choice([0, 1, 7, 30, 2_000_000_000]), float(k)) for k in range(40)]
    ranges += [("c", 5, 9, 1.0), ("c", 0, 20, 2.0), ("c", 5, 30, None), ("c", None, 50, 3.0)]
    places = [(d, k, at) for d in ("a", "b", "c", "d", None) for k, at in enumerate([*range(70), 1_999_999_999, None])]
    found = links.confidence_at(spark.createDataFrame(places, "doc string, id int, at int"), spark.createDataFrame(ranges, "doc string, start int, end int, confidence double"), ["doc"])
    plain = []
    for d, k, at in places:
        held = [(s, -1.0 if c is None else c) for x, s, e, c in ranges if None not in (d, at, s) and x == d and s <= at < e]
        plain.append((d, k, at, None if not held or min(held)[1] < 0 else min(held)[1]))
    got = [(r.doc, r.id, r.at, r.confidence) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_year_is_no_part_of_a_longer_number(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import links

    refs = ["Name, A. (1950). Title 19505", "Name, A. (1950). Title 11987", "Other, B. (1987a). Title 1"]
    references = spark.createDataFrame([("d", k, t) for k, t in enumerate(refs)], "doc_id string, idx long, text string")
    items = spark.createDataFrame([("d", i) for i in ("Name, 1950", "Name, 1987", "Other, 1987", "Other, 1987a")], "doc_id string, item string")
    found = links.match_references(items, references.where(F.col("idx") > 0)).collect()
    assert {r.item: r.reference for r in found} == {"Name, 1950": 1, "Name, 1987": -1, "Other, 1987": 2, "Other, 1987a": 2}


def test_confusions_that_lead_to_no_word_are_not_followed(spark, monkeypatch):
    from pagewright.operators import spelling

    asked, undone = [], spelling._undone
    monkeypatch.setattr(spelling, "_undone", lambda rows, pairs: asked.append(rows) or undone(rows, pairs))
    words = spark.createDataFrame([("rnodel",), ("rnodei",), *((f"{'linec' * 4}{k}",) for k in range(9))], "word string")
    found = spelling.confused(words, spark.createDataFrame([("model", 1.0)], "word string, freq double"))
    assert {(r.word, r.candidate, round(r.cost, 1)) for r in found.collect()} == {("rnodel", "model", 0.3), ("rnodei", "model", 0.6)}
    assert {r.word for r in asked[1].collect()} == {"rnodel", "rnodei"}
