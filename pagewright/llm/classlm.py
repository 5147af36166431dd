"""Language-model scoring by a Brown class-based bigram model.

A word's probability after another is that of its class after the other's class,
times that of the word in its class. The most frequent words, as many as the square root
of the training tokens, are put into classes, as many as the fourth root, by the
exchange algorithm: each word in turn moves to the class that raises the likelihood of
the class bigrams most, until none moves. The other words belong to classes by their form,
the end of a text is a class of its own, and so is the beginning. Transitions are
smoothed with the classes' own probabilities, words of the form classes by one count more.

The exchange is distributed: the bigrams of words are a written table, and the words are
dealt to groups of about ``GROUP`` bigrams. A round sends every group the classes of all
words; a group exchanges its own words one after the other, with exact counts of what
its moves change among them, and takes the other groups' classes as they were. The class
bigrams are counted anew after each round, and the best round's classes are kept. One
group is the algorithm as it is told.

All training texts are counted. What grows with the corpus stays distributed: counts
of words are combined within a task, shuffled by word, and written, and so are bigrams.
What tasks get is bounded by parameters: the ``head`` most frequent words with their
counts and classes, and the class bigrams. Words beyond the head, however many, meet
their counts in a join, as sums by document, so every count is exact. No key of that join
is frequent, since frequent words are in the head.

Defined cases: a null or empty text has the end token only; repeated rows each count
and each give a row; a null id counts as the empty text where rows are split; without
training texts every probability is that of no counts; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import arrow_rows, materialise, slices

END = b"\n"  # no word holds one
LENGTHS = (4, 8)
FORMS = 1 + 4 * (len(LENGTHS) + 1)
_DIGITS = frozenset(b"0123456789")
#: Different words, or bigrams, that a task counts before it hands them on.
COUNTED = 300_000
#: Bigrams of which a group of words is exchanged in a task.
GROUP = 500_000
#: Parts of a doubling, by which the head is cut off.
PER_DOUBLING = 8


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def form(word: bytes) -> int:
    """The class of a word that is not clustered."""
    if not _DIGITS.isdisjoint(word):
        return 0
    length = sum(len(word) > n for n in LENGTHS)
    last = word[-1]
    return 1 + length * 4 + 2 * (not word.isascii()) + (not (97 <= last <= 122 or last >= 0x80))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, the end tokens included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                held.update(words(text))
                held[END] += 1
                if len(held) >= COUNTED:
                    yield flush()
                    held.clear()
        yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent words: their counts and their units.

    A unit is a clustered word, or a form class, or the end, or the beginning.
    """

    def __init__(self, rows: list[tuple[bytes, int]], clustered: int):
        rows = sorted(((bytes(w), n) for w, n in rows if bytes(w) != END), key=lambda r: (-r[1], r[0]))
        self.clustered = min(clustered, len(rows))
        self.place = {w: k for k, (w, _) in enumerate(rows)}
        self.counts = np.array([n for _, n in rows], np.int64)
        self.end, self.begin = self.clustered + FORMS, self.clustered + FORMS + 1
        self.units = self.begin + 1
        self.unit = np.array([k if k < self.clustered else self.clustered + form(w) for k, (w, _) in enumerate(rows)], np.int32)

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """Each token's place in the head, or -1."""
        look = self.place.get
        return np.array([look(w, -1) for w in tokens], np.int64)

    def sequence(self, tokens: list[bytes], at: np.ndarray) -> np.ndarray:
        """The units from the beginning to the end."""
        out = np.full(len(tokens) + 2, self.end, np.int32)
        out[0] = self.begin
        beyond = np.flatnonzero(at < 0)
        out[1:-1] = self.unit[at] if len(self.unit) else 0
        if len(beyond):
            out[1 + beyond] = [self.clustered + form(tokens[k]) for k in beyond.tolist()]
        return out


def bigram_counts(docs: DataFrame, text_col: str, sent) -> DataFrame:
    """(a, b, n): how often unit b follows unit a, over all texts; a written table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        parts, count = [], 0

        def summed() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes // head.units, pa.int32()), pa.array(codes % head.units, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                tokens = words(text)
                s = head.sequence(tokens, head.places(tokens)).astype(np.int64)
                parts.append(s[:-1] * head.units + s[1:])
                count += len(s)
                if count > COUNTED:
                    yield summed()
                    parts, count = [], 0
        if parts:
            yield summed()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "a int, b int, n long")
    return materialise(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(joint: np.ndarray) -> float:
    """Of the class bigrams, but for what no exchange changes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum() - _xlogx(joint.sum(axis=1)).sum())


def first_classes(units: int, clustered: int, classes: int) -> np.ndarray:
    """Words in classes by rank; units beyond the clustered words have one of their own."""
    classes = max(1, min(classes, clustered))
    return np.array([k % classes if k < clustered else classes + k - clustered for k in range(units)], np.int32)


class Group:
    """Some words with the bigrams that they are part of, and their exchange."""

    def __init__(self, mine: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, of: np.ndarray, classes: int):
        """``mine`` are the words by rank; ``a``, ``b`` and ``n`` all bigrams with one of them."""
        self.mine, self.of, self.classes = mine, of.copy(), classes
        place = np.full(len(of), -1, np.int64)
        place[mine] = np.arange(len(mine))
        n_classes = int(of.max()) + 1
        n = n.astype(float)
        self.left, self.right, self.own = (np.zeros((len(mine), n_classes)), np.zeros((len(mine), n_classes)), np.zeros(len(mine)))
        pa_, pb = place[a], place[b]
        np.add.at(self.right, (pa_[pa_ >= 0], of[b[pa_ >= 0]]), n[pa_ >= 0])
        np.add.at(self.left, (pb[pb >= 0], of[a[pb >= 0]]), n[pb >= 0])
        both = (pa_ >= 0) & (pb >= 0)
        same = both & (a == b)
        np.add.at(self.own, pa_[same], n[same])
        self.after, self.before = self._lists(pa_[both], pb[both], n[both]), self._lists(pb[both], pa_[both], n[both])

    def _lists(self, one: np.ndarray, other: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(one, kind="stable")
        edges = np.searchsorted(one[order], np.arange(len(self.mine) + 1))
        return [(other[order[i:j]], n[order[i:j]]) for i, j in zip(edges, edges[1:])]

    def exchange(self, joint: np.ndarray) -> int:
        """Moves each word to its best class, the first of equals; the number of words that moved."""
        joint, classes, moved = joint.astype(float).copy(), self.classes, 0
        total_l, total_r = joint.sum(axis=0), joint.sum(axis=1)
        for k, w in enumerate(self.mine.tolist()):
            g, own = int(self.of[w]), self.own[k]
            before, after = self.left[k].copy(), self.right[k].copy()
            before[g] -= own  # its own following itself is counted apart
            after[g] -= own
            joint[:, g] -= before
            joint[g, :] -= after
            joint[g, g] -= own
            n_before, n_after = before.sum(), after.sum()
            total_l -= after
            total_r -= before
            total_l[g] -= n_before + own
            total_r[g] -= n_after + own
            inner = joint.diagonal()[:classes].copy()
            x, y = np.flatnonzero(before), np.flatnonzero(after)
            column, row = joint[x, :classes].T, joint[:classes, y]
            gain = (_xlogx(column + before[x]) - _xlogx(column)).sum(axis=1) + (_xlogx(row + after[y]) - _xlogx(row)).sum(axis=1)
            b, a = before[:classes], after[:classes]
            # the cell of a class with itself takes both at once
            gain += _xlogx(inner + b + a + own) + _xlogx(inner) - _xlogx(inner + b) - _xlogx(inner + a)
            size_l, size_r = total_l[:classes] + a, total_r[:classes] + b
            gain -= _xlogx(size_l + n_before + own) - _xlogx(size_l) + _xlogx(size_r + n_after + own) - _xlogx(size_r)
            h = int(np.argmax(gain))
            if gain[h] <= gain[g] + 1e-9 * (1 + abs(gain[g])):
                h = g
            joint[:, h] += before
            joint[h, :] += after
            joint[h, h] += own
            total_l += after
            total_r += before
            total_l[h] += n_before + own
            total_r[h] += n_after + own
            if h != g:
                moved += 1
                self.of[w] = h
                for at, n, counts in ((*self.after[k], self.left), (*self.before[k], self.right)):
                    np.add.at(counts, (at, g), -n)
                    np.add.at(counts, (at, h), n)
        return moved


def joint_counts(bigrams: np.ndarray, of: np.ndarray) -> np.ndarray:
    n = int(of.max()) + 1
    joint = np.zeros((n, n))
    np.add.at(joint, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), bigrams)
    return joint


def exchange(bigrams: np.ndarray, clustered: int, classes: int, rounds: int = 20) -> np.ndarray:
    """The class of each unit of a dense table of bigrams, with all words in one group."""
    of = first_classes(len(bigrams), clustered, classes)
    a, b = np.nonzero(bigrams)
    for _ in range(rounds):
        group = Group(np.arange(clustered), a, b, bigrams[a, b], of, max(1, min(classes, clustered)))
        moved, of = group.exchange(joint_counts(bigrams, of)), group.of
        if not moved:
            break
    return of


def class_bigrams(bigrams: DataFrame, of: np.ndarray) -> np.ndarray:
    """The class bigrams of a table of bigrams."""
    n = int(of.max()) + 1
    sent = bigrams.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for x in batches:
            code = sent.value[x.column(0).to_numpy()].astype(np.int64) * n + sent.value[x.column(1).to_numpy()]
            np.add.at(total, code, x.column(2).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    found = bigrams.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    out = np.zeros(n * n)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def _exchanged(sent, clustered: int, classes: int, groups: int):
    def run(rows: pa.Table) -> pa.Table:
        known, joint = sent.value
        mine = np.arange(rows.column("g")[0].as_py(), clustered, groups)
        held = Group(mine, *(rows.column(c).to_numpy() for c in ("a", "b", "n")), known, classes)
        held.exchange(joint)
        return pa.table([pa.array(mine, pa.int32()), pa.array(held.of[mine], pa.int32())], names=["word", "class"])

    return run


def clusters(bigrams: DataFrame, units: int, clustered: int, classes: int, rounds: int = 4, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit by the distributed exchange, and the class bigrams."""
    spark = bigrams.sparkSession
    groups = max(1, -(-bigrams.count() // group))
    of = first_classes(units, clustered, classes)
    classes = max(1, min(classes, clustered))
    best = None
    for _ in range(rounds + 1):
        joint = class_bigrams(bigrams, of)
        worth = likelihood(joint)
        if best is not None and worth <= best[0] + 1e-5 * abs(best[0]):
            break
        best = worth, of, joint
        if not clustered:
            break
        sent = spark.sparkContext.broadcast((of, joint))

        # a bigram goes to the groups of both its words
        mine = F.filter(F.array_distinct(F.array(F.when(F.col("a") < clustered, F.col("a") % groups), F.when(F.col("b") < clustered, F.col("b") % groups))), lambda g: g.isNotNull())
        moved = bigrams.withColumn("g", F.explode(mine)).groupBy("g").applyInArrow(_exchanged(sent, clustered, classes, groups), "word int, class int").toArrow()
        sent.unpersist()
        of = of.copy()
        of[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return best[1], best[2]


class Model:
    """Log10 probabilities of transitions and of words in their classes, and of the base."""

    def __init__(self, head: Head, of: np.ndarray, joint: np.ndarray, form_tokens: np.ndarray, form_words: np.ndarray, tokens: int, distinct: int, backoff: float = 10.0):
        self.of = of
        n = len(joint)
        reached = np.arange(n) != of[head.begin]
        own = np.where(reached, joint.sum(axis=0) + 1, 0)
        own = own / own.sum()
        self.step = np.log10(np.maximum((joint + backoff * own) / (joint.sum(axis=1, keepdims=True) + backoff), 1e-300))
        # a form class gives (count + 1) / beyond_form; the count comes later
        self.beyond_form = np.log10(form_tokens + form_words + 1.0)
        self.base_beyond = np.log10(tokens + distinct + 1.0)
        in_class = np.bincount(of[: head.clustered], weights=head.counts[: head.clustered], minlength=n)
        self.emit = np.empty(len(head.counts))
        m = head.clustered
        self.emit[:m] = np.log10(head.counts[:m]) - np.log10(np.maximum(in_class[of[:m]], 1))
        self.emit[m:] = np.log10(head.counts[m:] + 1.0) - self.beyond_form[head.unit[m:] - m]
        self.base = np.log10(head.counts + 1.0) - self.base_beyond

    def score(self, head: Head, text: str | None, ends: int) -> tuple[int, int, float, float, list[dict]]:
        """(tokens, known, base, score, words beyond the head); counts of those are still to be added."""
        tokens = words(text)
        at = head.places(tokens)
        units = head.sequence(tokens, at)
        steps = self.of[units]
        inside = at[at >= 0]
        score = float(self.step[steps[:-1], steps[1:]].sum() + self.emit[inside].sum())
        base = float(self.base[inside].sum() + np.log10(ends + 1.0) - self.base_beyond)
        beyond = np.flatnonzero(at < 0)
        rest: list[dict] = []
        if len(beyond):
            score -= float(self.beyond_form[units[1 + beyond] - head.clustered].sum())
            base -= len(beyond) * self.base_beyond
            rest = [{"word": w, "n": n} for w, n in Counter([tokens[k] for k in beyond.tolist()]).items()]
        return len(tokens) + 1, len(inside) + (ends > 0), base, score, rest


def train(docs: DataFrame, text_col: str = "text", head: int = 1 << 18, clustered: int | None = None, classes: int | None = None, rounds: int = 4, group: int = GROUP) -> tuple[Model, Broadcast, DataFrame, int, int]:
    """The model, its head as it was sent to the tasks, the words beyond the head with their counts, all training tokens, and end tokens.

    Unless they are given, ``clustered`` is the square root of the training tokens and
    ``classes`` the fourth root.
    """
    counts = materialise(word_counts(docs, text_col), "words")
    n = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    tokens, distinct, ends = (x or 0 for x in n)
    # the head ends where another step of frequency would make it too large
    level = F.floor(F.log2("n") * PER_DOUBLING).cast("int")
    cut, size = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if size + r.n > head:
            break
        cut, size = r.level, size + r.n
    inside = level >= (cut if cut is not None else 1 << 20)
    clustered = round(tokens**0.5) if clustered is None else clustered
    classes = max(2, round(tokens**0.25)) if classes is None else classes
    held = Head([tuple(r) for r in counts.where(inside).collect()], clustered)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
        place, clustered = sent.value.place, sent.value.clustered
        for b in batches:
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                if word != END and place.get(word, clustered) >= clustered:
                    k = form(word)
                    total[k] += n
                    found[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(FORMS), pa.int32()), pa.array(total), pa.array(found)], names=["form", "tokens", "words"])

    by_form = {r.form: r for r in counts.mapInArrow(forms, "form int, tokens long, words long").groupBy("form").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()}
    form_tokens, form_words = (np.array([by_form[k][c] if k in by_form else 0 for k in range(FORMS)]) for c in ("tokens", "words"))
    of, joint = clusters(bigram_counts(docs, text_col, sent), held.units, held.clustered, classes, rounds, group)
    model = Model(held, of, joint, form_tokens, form_words, tokens, distinct)
    return model, sent, counts.where(~inside), tokens, ends


def held_out(id_col, parts: int = 7, part: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    ``perplexity`` is 10 to the power of minus the score by token.
    """
    kind = dict(docs.dtypes)[id_col]
    model, head, rare, tokens, ends = train(docs.where(~held_out(id_col)), text_col, **how)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType.fromDDL(f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word binary, n int>>")
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, 256):
                held = []
                for i, out_of, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    held.append((row, i, out_of, *sent.value.score(head.value, text, ends)))
                    row += 1
                yield arrow_rows(held, arrow)

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = materialise(rows.mapInArrow(run, out), "scored")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    sums = rest.join(rare, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    both = scored.drop("rest").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    found = both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
