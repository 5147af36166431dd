"""The pipeline's near-dedup stage against all pairs by exact Jaccard similarity of five-word shingles."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from pagewright.llm import nearcopies as N  # noqa: E402

from test_simhash import groups  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)} if w else set()


def kept(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    alike = lambda x, y: x == y or len(x & y) * 10 >= 8 * len(x | y)
    least = groups([i for i, _ in sets], [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if alike(x, y)])
    return sorted(i for i, root in least.items() if i == root)


def test_stage_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two")]
    for n in (40, 120, 300):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(50)) for _ in range(n)]
        for _ in range(30):
            x = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                x[rng.randrange(n)] = "other" + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(x)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect())
    want = kept(rows)
    assert got == want and 5 < len(want) < len(rows)


def test_stage_on_the_smallest_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, small).collect()) == kept(rows)


def test_a_link_behind_many_likelier_pairs(spark):
    """Of 200 texts of one group a longer one is linked with a single one; the sketches take many others for nearer."""
    rng = random.Random(8)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = own(164)
    texts = [shared + own(10), *(shared + own(11) for _ in range(200)), shared + own(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert kept(rows) == [0] and kept(rows[1:]) == [1, 201]
    assert [r.doc_id for r in P.near_dedup(spark, docs, "").collect()] == [0]


def test_copies_that_meet_by_a_fingerprint_only(spark):
    """Neither the node that stands for a fingerprint nor the bands are needed to find a link."""
    texts = {1: "a b c d e f", 2: "k l m n o p", 3: "K l m n o p", 4: "q r s t u v", 5: "k L m n o p"}
    prints = {1: 8, 2: 8, 3: 8, 4: 9, 5: 9}
    sketch = {k: N.sketch(N.minima(N.hashes(t, 5)), N.hashes(t, 5)) for k, t in texts.items()}
    rows = spark.createDataFrame(
        [(k, t, k, prints[k], sketch[k], []) for k, t in texts.items()], "row long, text string, key long, fp long, sketch binary, bands array<long>"
    )
    found = N.links(rows, rows.select("key", "row"), 5, 0.8, 2)
    assert groups(list(texts), [(r.a, r.b) for r in found.collect()]) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 2}


def test_the_bound_of_a_sketch_loses_no_link():
    rng = np.random.default_rng(4)
    one, two, alike = [], [], []
    for n in range(1, 4001, 40):
        shared, left = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, n // 4 + 1)
        for own in (left, n // 2):  # linked, and half as similar
            a = np.concatenate([shared, rng.integers(0, 1 << 63, own, np.uint64)])
            b = np.concatenate([shared, rng.integers(0, 1 << 63, n // 4 - left, np.uint64)])
            for sets, x in ((one, a), (two, b)):
                sets.append(np.frombuffer(N.sketch(N.minima(x), np.unique(x)), np.uint8))
            alike.append(n * 10 >= 8 * (len(a) + len(b) - n))
    got = N.possible(np.stack(one), np.stack(two), 0.8)
    assert got[alike].all() and got.sum() < len(got) * 0.9
    assert N.possible(*[np.frombuffer(N.sketch(N.minima(x), x), np.uint8)[None] for x in [np.zeros(0, np.uint64)] * 2], 0.8).all()
