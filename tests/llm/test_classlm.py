import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pagewright.llm import classlm as C


def is_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain(rows):
    counts = Counter()
    for i, t in rows:
        if not is_out(i):
            counts.update((t or "").encode().lower().split())
            counts[b"\n"] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        out.append((i, is_out(i), len(tokens), sum(w in counts for w in tokens), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), 6)))
    return sorted(out, key=str)


def scored(df, **how):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in C.score(df, **how).collect()), key=str)


@pytest.mark.parametrize("head", [1 << 18, 300, 0])
def test_base_scores(spark, small, head):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert scored(docs, head=head, clustered=60, classes=8) == plain(rows)


def test_scores_don_t_depend_on_the_head(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in C.score(docs, head=h, clustered=40, classes=8).collect()} for h in (1 << 18, 2000))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 * abs(one[k]) for k in one)


def test_classes_help_on_texts_not_seen(spark):
    rows = C.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.05
    assert abs(rows[0].perplexity - 10 ** (-rows[0].score / rows[0].n_tokens)) < 1e-6 * rows[0].perplexity


def likelihood(bigrams, of):
    joint = np.zeros((of.max() + 1,) * 2)
    np.add.at(joint, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), bigrams)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(joint) - f(joint.sum(0)) - f(joint.sum(1))


@pytest.mark.parametrize("seed", range(4))
def test_no_single_move_betters_the_classes(seed):
    bigrams = np.random.default_rng(seed).integers(0, 6, (15, 15))
    of = C.exchange(bigrams, 11, 3)
    best = likelihood(bigrams, of)
    for w in range(11):
        for h in range(3):
            other = of.copy()
            other[w] = h
            assert other.max() != of.max() or likelihood(bigrams, other) <= best + 1e-6


@pytest.mark.parametrize("group", [1 << 21, 3000])
def test_scores_by_hand(spark, small, group):
    """Scores from classes as they were found, by plain counting of the training texts."""
    how = {"head": 700, "clustered": 40, "classes": 5, "group": group}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model, head, _, _, _ = C.train(docs.where(~C.held_out("doc_id")), **how)
    words = [None] * len(head.value.place)
    for w, k in head.value.place.items():
        words[k] = w
    class_of = {w: ("class", int(model.of[k])) for k, w in enumerate(words[:40])}
    assert len(set(class_of.values())) == 5
    name = lambda w: class_of.get(w) or ("form", C.form(w))
    said = {i: (t or "").encode().lower().split() for i, t in rows}
    counts, steps, sizes = Counter(), Counter(), Counter()
    for i, tokens in said.items():
        if not is_out(i):
            counts.update(tokens)
            path = ["begin", *map(name, tokens), "end"]
            steps.update(zip(path, path[1:]))
            sizes.update(path[:-1])
    kinds = {("class", k) for k in range(5)} | {("form", k) for k in range(C.FORMS)} | {"end"}
    reached = Counter()
    for (_, b), n in steps.items():
        reached[b] += n
    own = {k: (reached[k] + 1) / (sum(reached.values()) + len(kinds)) for k in kinds}
    in_class, forms, distinct = Counter(), Counter(), Counter()
    for w, n in counts.items():
        in_class[name(w)] += n
        forms[name(w)] += n
        distinct[name(w)] += 1
    got = {r.doc_id: r.score for r in C.score(docs, **how).collect()}
    for i, tokens in said.items():
        path, want = ["begin", *map(name, tokens), "end"], 0.0
        for a, b in zip(path, path[1:]):
            want += math.log10((steps[a, b] + 10 * own[b]) / (sizes[a] + 10))
        for w in tokens:
            k = name(w)
            want += math.log10(counts[w] / in_class[k] if k[0] == "class" else (counts[w] + 1) / (forms[k] + distinct[k] + 1))
        assert abs(got[i] - want) < 1e-6 * abs(want), i


def test_groups_better_the_classes(spark):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 4, 60)
    often = rng.integers(1, 9, (4, 4)) ** 3
    bigrams = rng.poisson(often[kind][:, kind] / 4.0)
    a, b = np.nonzero(bigrams)
    table = spark.createDataFrame([(int(x), int(y), int(bigrams[x, y])) for x, y in zip(a, b)], "a int, b int, n long")
    one = C.likelihood(C.joint_counts(bigrams, C.exchange(bigrams, 57, 4)))
    first = C.likelihood(C.joint_counts(bigrams, C.first_classes(60, 57, 4)))
    for group in (1 << 20, len(a) // 3):
        of, joint = C.clusters(table, 60, 57, 4, 20, group)
        assert np.array_equal(joint, C.joint_counts(bigrams, of))
        assert C.likelihood(joint) > first + 0.9 * (one - first)


def test_clusters_grow_with_the_corpus(spark, small):
    model, head, _, tokens, _ = C.train(spark.read.parquet(f"{small}/documents.parquet"))
    assert head.value.clustered == round(tokens**0.5) and len(set(model.of[: head.value.clustered].tolist())) > 0.5 * tokens**0.25


def test_probabilities_add_up(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, sent, rare, _, _ = C.train(docs, head=500, clustered=50, classes=6)
    head = sent.value
    reached = np.arange(len(model.step)) != model.of[head.begin]
    assert np.allclose((10.0 ** model.step[:, reached]).sum(axis=1), 1)
    # in each class: the words in the head, those beyond it, and one for all unseen
    by_class = np.zeros(len(model.step))
    np.add.at(by_class, model.of[head.unit], 10.0**model.emit)
    for r in rare.collect():
        if bytes(r.word) != C.END:
            k = C.form(bytes(r.word))
            by_class[model.of[head.clustered + k]] += (r.n + 1) / 10 ** model.beyond_form[k]
    for k in range(C.FORMS):
        by_class[model.of[head.clustered + k]] += 1 / 10 ** model.beyond_form[k]
    inside = np.arange(len(by_class)) < model.of[head.end]
    assert np.allclose(by_class[inside & (by_class > 0)], 1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Word word"), (3, "Word word"), (None, "word other"), (None, None), (4, "x " * 30_000)]
    rows += [(k, "some text here") for k in range(5, 30)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, word string")
    for head in (1 << 18, 0):
        assert scored(df, head=head) == plain(rows)
    assert C.score(df.limit(0)).collect() == []
    only = spark.createDataFrame([(i, "a b") for i in range(60) if is_out(i)], "doc_id long, text string")
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in C.score(only).collect())
