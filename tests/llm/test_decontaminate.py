import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pagewright.llm import _shared as S
from pagewright.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, size):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            for k in range(max(len(x) - size, 0) + 1):
                p = x[k : k + size]
                for at in range(len(w) - len(p) + 1) if p else ():
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def plain_near(docs, items, size, slack=2, misses=1):
    """(id, words near, items near) by counting, for every start, the words of a window that are near their places."""
    windows = {}
    for item, t in items:
        x = words(t)
        for k in range(max(len(x) - size, 0) + 1):
            if x:
                windows.setdefault(tuple(x[k : k + size]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, near, found, at = words(text), set(), set(), {}
        for k, word in enumerate(w):
            at.setdefault(word, []).append(k)
        for p, named in windows.items():
            if len(p) < size:
                starts = [k for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p] if p[0] in at else []
            elif sum(word not in at for word in p) > misses:
                continue
            else:
                counts = Counter(s for j, word in enumerate(p) for s in {k - j + d for k in at.get(word, ()) for d in range(-slack, slack + 1)})
                starts = [s for s, n in counts.items() if n >= size - misses]
            for s in starts:
                near.update(range(max(s, 0), min(s + len(p), len(w))))
                found |= named
        out.append((i, len(near), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_equals_search_by_hand(spark, block):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1", "e,", "f.", "g", "h", "i", "j"]) for _ in range(n))
    items = [(k, say(rng.randint(1, 14))) for k in range(30)] + [(100, None), (101, ""), (102, "..."), (3, "a B a B a")]
    docs = [(k, say(rng.randint(0, 40))) for k in range(60)] + [(None, None), (200, ""), (5, "x " + items[0][1]), (5, "x " + items[0][1])]
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda got, key: sorted(((r[key], r.n_words, sum(x.e - x.s for x in r.ranges), ",".join(r["items"])) for r in got), key=str)
    nears = lambda got, key: sorted(((r[key], sum(x.e - x.s for x in r.near), ",".join(r["near_items"])) for r in got), key=str)
    for size in (4, 7):
        got = D.contamination(df, bench, size=size, block=block).collect()
        assert rows(got, "doc_id") == plain(docs, items, size)
        assert nears(got, "doc_id") == plain_near(docs, items, size)
    for shard in (1_000_000, 70):
        index = D.build_index(df, shard_words=shard)
        got = D.search_index(index, bench, size=7, block=block).collect()
        assert rows(got, "id") == plain(docs, items, 7) and nears(got, "id") == plain_near(docs, items, 7)
        few = bench.where("item_id < 2")
        assert rows(D.search_index(index, few, size=4).collect(), "id") == plain(docs, [x for x in items if x[0] < 2], 4)
    bad = {i for i, _, n, _ in plain(docs, items, 7) if n} | {i for i, n, _ in plain_near(docs, items, 7) if n}
    for sent in (1 << 20, 0):
        kept = D.without_contaminated(df, bench, sent=sent, size=7, block=block)
        assert kept.columns == df.columns
        assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(((i, t, "n") for i, t in docs if i not in bad), key=str)


def index_of(windows, texts):
    lists, begins = {}, [0]
    for t in texts:
        for k, w in enumerate(t):
            if w in windows.ids:
                lists.setdefault(windows.ids[w], []).append(begins[-1] + k)
        begins.append(begins[-1] + len(t) + 1)
    return D.Index({k: np.array(v) for k, v in lists.items()}, len(windows.ids), np.array(begins))


def test_long_documents():
    windows = D.Windows([(1, "one two three four")], 3)
    long = [b"zero"] * 200_000 + [b"one", b"two", b"three"] + [b"zero"] * 5
    texts = [long, [], [b"two", b"three", b"four"]]
    got = D.search(windows, index_of(windows, texts))
    assert [(x.ranges, x.items) for x in got] == [([(200_000, 200_003)], {1}), ([], set()), ([(0, 3)], {1})]
    # a phrase doesn't go on in the next document, and no proximity match does
    for slack in (0, 2, 5):
        got = D.search(windows, index_of(windows, [[b"one"], [b"two"], [b"three", b"four"]]), slack, 0)
        assert [(x.ranges, x.near) for x in got] == [([], [])] * 3


def test_proximity():
    windows = D.Windows([(7, "one two three")], 3)
    near = lambda text, slack, misses: D.merged(D.search(windows, index_of(windows, [text.encode().split()]), slack, misses)[0].near)
    assert near("x one two three x", 0, 0) == [(1, 4)]
    assert near("x one and two three x", 0, 0) == [] and near("x one and two three x", 1, 0) != []
    assert near("x one word three x", 0, 1) == [(1, 4)] and near("x one word three x", 0, 0) == []
    assert near("three two one", 1, 0) == [] and near("three two one", 2, 0) == [(0, 3)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.digests(docs.limit(0), items).collect() == []
    assert D.without_contaminated(docs.limit(0), items).collect() == []
    r = D.digests(docs, items.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.n_near, r.near_items) == (2, 0, 0, False, 0, "")


def test_a_shard_holds_a_word_once():
    from pagewright.llm import decontaminate

    known = decontaminate._Numbers()
    texts = [known.of(t) for t in ("a b a", None, "B c", "")]
    assert [t.tolist() for t in texts] == [[0, 1, 0], [], [1, 2], []] and list(known) == [b"a", b"b", b"c"]


def test_few_texts_at_once(spark):
    """The index is built from at most TEXTS rows at a time, and the session's own number holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    rows = spark.range(2500, numPartitions=1).mapInArrow(sizes, "n long")
    assert sorted(r.n for r in S.materialise(rows, "sizes", texts=True).collect()) == [500, S.TEXTS, S.TEXTS]
    assert spark.conf.get(key) == before
