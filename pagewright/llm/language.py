"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit, a binary classifier over hashed byte
trigrams tells the languages whose bit is 1 from those whose bit is 0; its weights
are the log-odds of the trigram in the two halves, every language weighing the same.
A text's margin for a bit is the mean log-odds of its trigrams times their number,
at most ``evidence``. A codeword's loss is the sum over bits of log(1 + exp(-bit *
margin)), each weighted by how far the bit's halves lie apart; the least loss wins.
The score is the winner's share in the softmax of the losses, and a text is
ambiguous if the score is under ``sure``.

All labelled rows are counted, none is sampled: a task adds up trigrams by language,
and only the sums (languages x ``BUCKETS``) are shuffled and sent to the driver. The
prediction reads whole texts in a map without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; without
any labelled row every text is ``und``; with one language every other text gets it;
rows with a null language teach nothing; repeated rows each count and each give a
row; a null id counts as the empty text where rows are split by id; columns other
than the id, text and language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import slices

UND = "und"
BITS = 14
BUCKETS = 1 << BITS
CHUNK = 1 << 22
_LETTER = re.compile(r"[^\W\d_]")
# Anything in ASCII but letters is a space.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256)).lower()


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


def grams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, beginning and end included."""
    raw = np.frombuffer(b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" ", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(raw) - 2, CHUNK):
        a = raw[k : k + CHUNK + 2].astype(np.uint32)
        code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return out


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows that have a language and a letter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for text, lang in zip(*(c.to_pylist() for c in b.columns)):
                if text and _LETTER.search(text):
                    if lang in sums:
                        sums[lang] += grams(text)
                    else:
                        sums[lang] = grams(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """+1 and -1, a row for each of ``n`` languages.

    Up to seven languages every split in two halves is a bit; beyond, the best by
    least distance of some drawn codes of 10 bits for each doubling.
    """
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1)][1:], float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, int(np.ceil(10 * np.log2(n)))))
        code[0, (code == code[0]).all(axis=0)] *= -1
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    """Languages, their codewords, the weights of the bits' classifiers and of the bits."""

    def __init__(self, rows: list[tuple], evidence: float = 24.0, sure: float = 0.6):
        self.languages = sorted({r[0] for r in rows})
        self.evidence, self.sure = evidence, sure
        self.code = codewords(len(self.languages))
        share = np.ones((len(self.languages), BUCKETS))
        place = {x: k for k, x in enumerate(self.languages)}
        for lang, bucket, n in rows:
            share[place[lang], bucket] += n
        share /= share.sum(axis=1, keepdims=True)
        ones = [share[self.code[:, b] > 0].mean(axis=0) for b in range(self.code.shape[1])]
        zeros = [share[self.code[:, b] < 0].mean(axis=0) for b in range(self.code.shape[1])]
        odds = [np.log(p) - np.log(q) for p, q in zip(ones, zeros)]
        self.weights = np.array(odds, np.float32).reshape(-1, BUCKETS).T
        apart = np.array([((p - q) * w).sum() for p, q, w in zip(ones, zeros, odds)])
        self.reliable = apart / apart.mean() if len(apart) and apart.mean() > 0 else np.ones(len(apart))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        at = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.languages or not at:
            return out
        if len(self.languages) == 1:
            for k in at:
                out[k] = (self.languages[0], 1.0, False)
            return out
        x = np.stack([grams(texts[k]) for k in at]).astype(np.float32)
        n = x.sum(axis=1, keepdims=True)
        margins = (x @ self.weights) / n * np.minimum(n, self.evidence)
        losses = np.logaddexp(0, -margins[:, None, :].astype(float) * self.code[None]) @ self.reliable
        best = losses.argmin(axis=1)
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        score = 1 / share.sum(axis=1)
        for k, b, s in zip(at, best.tolist(), score.tolist()):
            out[k] = (self.languages[b], s, s < self.sure)
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **how) -> Model:
    return Model([tuple(r) for r in counts(docs, text_col, lang_col).collect()], **how)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), batch: int = 64, with_text: bool = False) -> DataFrame:
    """The columns named in ``keep``, the text if asked for, then lang_pred, score and ambiguous, for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    if with_text:
        kept.append(T.StructField("text", T.StringType()))
    out = T.StructType([*kept, *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                found = zip(*sent.value.predict(part.column(0).to_pylist()))
                columns = [*part.columns[1:], *([part.column(0)] if with_text else []), *(pa.array(list(v)) for v in found)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    found = rows.mapInArrow(run, out)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(["text"] if with_text else []), "lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, **how)
    found = predict(docs, model, text_col, (id_col,))
    return found.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "ambiguous")
