import numpy as np
import pytest
from pagewright.llm import topk


def plain(rows, every, k):
    """Every row but the query's own, by place in the table, so that repeated rows count."""
    out = []
    for n, (qi, q) in enumerate(rows):
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "spread"), [(400, 16, 30), (60, 3, 2), (4, 64, 9), (300, 8, 1 << 28), (200, 4, 1 << 31)])
@pytest.mark.parametrize("block", [37, 4096])
def test_blocks_equal_all_pairs(n, width, spread, block):
    rng = np.random.default_rng(n)
    rows = rng.integers(-spread, spread, (n, width))
    rows[1] = rows[0]
    ids, numbers = np.arange(n) * 3 % 600, np.arange(n)
    best = topk.Best(rows[::7], numbers[::7], 5)
    for at in range(0, n, block):
        best.add(rows[at : at + block], numbers[at : at + block], ids[at : at + block])
    got = sorted((int(i), v, -s) for i, held in zip(ids[::7], best.held) for s, v in held)
    every = [(int(i) if k % 7 == 0 else 1, [int(x) for x in v]) for k, (i, v) in enumerate(zip(ids, rows))]
    want = []
    for k in range(0, n, 7):
        scored = sorted((-sum(a * int(b) for a, b in zip(every[k][1], rows[m])), int(ids[m])) for m in range(n) if m != k)
        want += [(int(ids[k]), v, -s) for s, v in scored[:5]]
    assert got == sorted(want)


def test_few_are_left_to_resolve():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 64)) * 32).astype(int)
    able, _ = topk.aggregate(rows[:50], rows, np.arange(4000)[:, None] == np.arange(50)[None, :], 5)
    assert max(map(len, able)) < 1000


def test_reading_stops_before_the_lists_are_read():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 4)) * 64).astype(int)
    none = np.zeros((4000, 20), bool)
    able, part = topk.aggregate(rows[:20] * 3, rows, none, 5)
    assert part < 0.5 and max(map(len, able)) < 400
    # a score known from an earlier block stops it sooner still
    known = np.sort(rows @ (rows[:20] * 3).T, axis=0)[-5]
    again, sooner = topk.aggregate(rows[:20] * 3, rows, none, 5, known.astype(object))
    assert sooner <= part and sum(map(len, again)) <= sum(map(len, able))


def test_search(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6).round(3)]) for k in range(230)]
    rows += [(900, [0.5, 0.25]), (901, [0.125, 1.0]), (950, [0.1, 0.2]), (1000, rows[3][1]), rows[0], rows[0], rows[7], rows[7]]
    odd = [(1100, None), (1150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1250, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + odd], "vec_id long, embedding array<double>, rank string")
    want = plain([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows], 50, 5)
    assert len(want) > 5 * 8
    for blocks in ({}, {"query_block": 2, "row_block": 40}):
        got = topk.search(df, **blocks)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert topk.search(df.limit(0)).collect() == []
    assert topk.search(df.where("vec_id = 950")).collect() == []
