"""The pipeline against a plain version of its stages, on the smallest tables and on odd rows."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from pagewright.llm import _shared, pii, spans  # noqa: E402
from pagewright.llm._shared import materialise  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from test_decontaminate import plain as plain_hits  # noqa: E402
from test_decontaminate import plain_near  # noqa: E402
from test_mixing import plain_targets  # noqa: E402
from test_nearcopies import kept  # noqa: E402
from test_scans import plain_terms  # noqa: E402


def plain_pii(texts):
    return [spans.replaced(t, found, pii.MARKS) if found else t for t, found in zip(texts, plain_terms(texts))]


def test_stages_on_the_smallest_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    place = {c: k for k, c in enumerate(docs.columns)}
    text, ident, source = place["text"], place["doc_id"], place["source"]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, small), "stage")
        got = sorted((tuple(r) for r in docs.collect()), key=str)
        if name == "language id":
            # every clean text has letters of one language
            want = rows
        elif name == "simhash near-dedup":
            # a pipeline stage is due five words and a similarity of 0.8
            first = set(kept([(r[ident], r[text]) for r in rows]))
            want = [r for r in rows if r[ident] in first]
            assert len(want) < len(rows)
        elif name == "benchmark decontamination":
            texts = [(r[ident], r[text]) for r in rows]
            hit = {i for i, _, n, _ in plain_hits(texts, items, 10) if n} | {i for i, n, _ in plain_near(texts, items, 10) if n}
            want = [r for r in rows if r[ident] not in hit]
            assert len(want) < len(rows)
        elif name == "pii":
            clean = plain_pii([r[text] for r in rows])
            want = []
            for r, t in zip(rows, clean):
                row = list(r)
                row[text] = t
                if t != r[text]:
                    row[place["n_chars"]] = len(t)
                want.append(tuple(row))
        else:
            sizes = {}
            for r in rows:
                sizes[r[source]] = sizes.get(r[source], 0) + len(r[text].split())
            goal = plain_targets(sizes)
            again = {}
            for r in got:
                again[r] = again.get(r, 0) + 1
            for r in rows:
                rate = goal[r[source]] / sizes[r[source]]
                assert int(rate) <= again.get(r, 0) <= int(rate) + 1
            assert set(got) <= set(rows)
            want = got
        assert got == sorted(want, key=str), name
        rows = want
    assert [n for n, _ in P.STAGES][0] == "language id" and len(P.STAGES) == 5


def test_run(spark, small):
    assert P.run(spark, small).columns == spark.read.parquet(f"{small}/documents.parquet").columns


def odd(spark, more=()):
    said = "the people of the town were out in the rain and on the road "
    rows = [(k, said * 2 + " ".join(f"number{k} case{k * 7} turn{j}{k}" for j in range(9)), "en", "s", 1, "x") for k in range(40)]
    rows += [(100, None, "en", "s", 0, "y"), (101, "", None, None, 0, None), (102, "12 34", "en", None, 5, None), (None, rows[0][1] + " mail jane@doe.org", None, "t", 2, None), rows[1], rows[1]]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars int, id string")
    return docs.withColumn("a.b", F.col("id")).withColumn("__doc", F.lit(1)).withColumn("c`d", F.lit("e")).withColumn("band", F.lit(2))


def test_odd_rows(spark, small):
    docs = odd(spark)
    empty = docs.limit(0)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    got = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert stage(spark, empty, small).collect() == [], name
        got[name] = ids(out)
        if name != "pii":  # rows come as they were
            assert {str(r) for r in out.collect()} <= {str(r) for r in docs.collect()}
    every = ids(docs)
    assert got["language id"] == [i for i in every if i not in (100, 101, 102)]
    # null and empty texts are one group, repeated rows another; the null id comes last
    assert got["simhash near-dedup"] == sorted([*range(40), 100, 102], key=str)
    assert got["benchmark decontamination"] == every and got["pii"] == every
    clean = {r.doc_id: r for r in P.personal_data(spark, docs, small).collect()}
    # the word beside the address, seen nowhere else, discloses it
    assert clean[None].text.endswith("[TERM] [EMAIL]") and clean[None].n_chars == len(clean[None].text)
    assert clean[100].text is None and clean[101].text == "" and clean[102].n_chars == 5
    # the target of a source is at most three times its words
    assert max(got["source mixing"].count(i) for i in set(got["source mixing"])) <= 3 * 3


def test_contaminated_rows_go_together(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    words = item.split()
    changed = " ".join([*words[:4], "altered", *words[5:]])
    docs = odd(spark, [(200, f"see {item} end", "en", "s", 1, "x"), (200, f"see {item} end", "en", "s", 1, "x"), (201, f"see {changed} end", "en", None, 1, None)])
    left = {r.doc_id for r in P.decontamination(spark, docs, small).collect()}
    assert not left & {200, 201} and {0, 39, 100, 101, 102, None} <= left


def test_nothing_is_left_in_the_shared_folder(spark, small):
    folder = Path(_shared.shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    assert P.run(spark, small).count() > 0
    names = sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before)
    assert names == sorted(n.replace(" ", "-") for n, _ in P.STAGES)
