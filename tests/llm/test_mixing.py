import random
import re

from pagewright.llm import mixing
from pyspark.sql import functions as F


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing anew by weight until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
        left -= sum(most * sizes[s] for s in over)
    return out


def test_targets(spark):
    rng = random.Random(8)
    for trial in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 1000, 9000]) for k in range(rng.randint(1, 9))} | ({None: 30, "": 7, "é": 2, "😀": 3} if trial % 2 else {})
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + k % 30), f"s{min(k % 10, 4)}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs).cache()
    for r in plan.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.08 * r.target
    assert plan.where("taken > 3 * size or (size > 0 and taken % size <> 0)").isEmpty()
    again = mixing.plan(docs.repartition(7, "text"), broadcast_rows=0)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, again.collect()))
    made = mixing.mix(docs)
    assert sorted(made.collect()) == sorted(mixing.mix(docs, broadcast_rows=0).collect())
    assert made.columns == docs.columns
    taken = {r.doc_id: r.n for r in made.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(taken.get(r.doc_id, 0) * r.size == r.taken for r in plan.collect())


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "  \x0b\x1f q", "b"), (5, "w " * 100_000, "c")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int")
    got = mixing.plan(docs).collect()
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert {r.target for r in got if r.doc_id in (1, 2)} == {0.0}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_native(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (mixing.plan(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
