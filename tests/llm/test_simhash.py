import random

import pytest
import xxhash
from pagewright.llm import simhash
from pagewright.llm.components import components
from pagewright.llm.queries import QUERIES


def plain_fingerprint(text, width=3):
    """The contract's words, with Python integers."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(ids, linked):
    """Each id's least reachable id."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_fingerprints():
    rng = random.Random(3)
    for text in [None, "", " \n ", "One", "a b", "a b c", "A b\tC d", "é É  x y z", *(" ".join(rng.choice("abcd") for _ in range(n)) for n in (5, 50, 400))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text
    long = " ".join(str(rng.random()) for _ in range(200_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


@pytest.mark.parametrize(("bits", "limit"), [(2, 50_000), (2, 7), (2, 1), (0, 10), (1, 3), (3, 20)])
def test_links_equal_all_pairs(spark, bits, limit):
    rng = random.Random(bits * 100 + limit)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, bits + 2)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = {(simhash.signed(a), simhash.signed(b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= bits}
    rows = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    got = [(r.a, r.b) for r in simhash.links(rows, bits, limit).collect()]
    assert len(got) * 2 == len(want)
    assert {*got, *((b, a) for a, b in got)} == want


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(300)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(700)] + [(5000, 5000 + k) for k in range(1, 400)]
    pairs += [(7, 7), (1, 0), (0, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    want = groups({i for p in pairs for i in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_odd_rows(spark):
    rows = [(3, None, "a"), (2, "", "b"), (5, "one two three four", "c"), (4, "one two three four", "d"), (4, "one two three four", "d"), (None, "one two three four", None), (None, "quite other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (5, 4), (4, 4), (4, 4), (None, 4), (None, None)], key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, ""), (4, "one two three four"), (None, "quite other words here")], key=str)
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.deduplicate(empty).collect() == []


def test_query_equals_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = QUERIES["op1_simhash_near_dedup"](spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(got) == len(ids)
