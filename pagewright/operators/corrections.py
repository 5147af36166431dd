"""Corrections of documents by a lexicon table (word, freq); the lexicon is joined and never sent."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import spelling as X
from . import spelling as S
from .blocks import kept

TOKENS = "start int, end int, token string, lead string, count int"


def _each(docs: DataFrame, schema: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(doc_id, the columns of ``schema``), a row for each that ``make`` gives for a text."""
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(schema)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = [(i, *found) for i, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)) for found in make(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def with_own_words(lexicon: DataFrame, own: Iterable[str]) -> DataFrame:
    """The lexicon with a reader's own words, which are few."""
    rows = [(w.lower(), 0.0) for w in own]
    return lexicon.select("word", "freq").unionByName(lexicon.sparkSession.createDataFrame(rows, "word string, freq double")) if rows else lexicon.select("word", "freq")


def corrections(docs: DataFrame, lexicon: DataFrame, mode: str = "review", threshold: float = 0.9, own: Iterable[str] = (), foreign: DataFrame | None = None, languages: tuple[str, ...] = ("en",), read: DataFrame | None = None) -> DataFrame:
    """(doc_id, correction_id, start, end, original, replacement, confidence, status) of documents (doc_id, text).

    ``read`` (doc_id, start, read) says how sure the recognition of a word was, from 0 to 100.
    """
    lexicon = with_own_words(lexicon, own)
    forms = kept(S.derived(lexicon))
    tokens = _each(docs.limit(0) if mode == "disabled" else docs, TOKENS, X.tokens)
    open_ = tokens.where(~S.is_protected(F.col("token"), F.col("lead"), F.col("count"), languages == ("en",))).withColumn("word", F.lower("token"))
    # each of these is a small table of distinct words, of which the next ones are made
    words = kept(S.misread(open_, forms, foreign))
    glued = kept(S.run_together(words, lexicon, languages, forms).where("glued").select("word", F.col("split").alias("replacement")))
    whole = words.join(glued, "word", "left_anti")
    candidates = kept(S.candidates(kept(whole.join(S.as_it_is(whole, forms), "word", "left_anti")), lexicon, forms))
    said = tokens.select("doc_id", F.lower("token").alias("candidate"), F.lit(True).alias("said")).distinct()
    rows = open_.join(candidates, "word").join(said, ["doc_id", "candidate"], "left").withColumn("in_doc", F.coalesce("said", F.lit(False)))
    rated = S.rated(rows if read is None else rows.join(read, ["doc_id", "start"], "left"), ["doc_id", "start"])
    both = rated.select("doc_id", "start", "end", "token", F.col("candidate").alias("replacement"), "confidence")
    both = both.unionByName(open_.join(glued, "word").select("doc_id", "start", "end", "token", "replacement", F.lit(S.GLUED_SURE).alias("confidence")))
    status = S.correction_status(F.col("confidence"), F.lit("paragraph"), mode, threshold)
    made = both.withColumn("replacement", S.in_case_of(F.col("token"), F.col("replacement"))).withColumn("status", status).where("status is not null")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("start"))
    return made.select("doc_id", F.concat(F.lit("c"), number.cast("string")).alias("correction_id"), "start", "end", F.col("token").alias("original"), "replacement", "confidence", "status")


def _where_known(rows: DataFrame, lexicon: DataFrame, condition: Callable[[dict[str, Column]], Column], columns: tuple[str, ...]) -> DataFrame:
    """The rows for which ``condition`` holds of which of their ``columns`` are known words."""
    lexicon = kept(S.derived(lexicon))
    rows = kept(rows)
    for c in columns:
        found = S.known(rows.where(F.col(c) != ""), lexicon, c).select(c, F.lit(True).alias(f"known_{c}"))
        rows = rows.join(found, c, "left")
    return rows.where(condition({c: F.coalesce(f"known_{c}", F.lit(False)) for c in columns}))


def ligature_gaps(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, end, joined): words split after fi, fl or ff, of which not both parts are words."""
    rows = _each(docs, "start int, end int, joined string, left string, right string, whole string", X.ligature_gaps)
    return _where_known(rows, lexicon, lambda k: k["whole"] & ~(k["left"] & k["right"]), ("left", "right", "whole")).select("doc_id", "start", "end", "joined")


def word_fixes(docs: DataFrame, lexicon: DataFrame, mistakes: list[tuple[str, str]] = ()) -> DataFrame:
    """Fixes by the reader's list and after fi, fl and ff; the list's come first."""
    from .links import without_overlap

    entries, schema = list(mistakes), "start int, end int, replacement string"
    listed = _each(docs, schema, lambda text: [x for x in X.listed_mistakes(text, entries) if x[2]]).withColumn("source", F.lit("list"))
    gaps = without_overlap(ligature_gaps(docs, lexicon).withColumnRenamed("joined", "replacement"), listed, ["doc_id"]).withColumn("source", F.lit("ligature"))
    both = listed.unionByName(gaps).join(docs.select("doc_id", "text"), "doc_id")
    original = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select("doc_id", F.concat_ws("-", "source", F.col("start").cast("string")).alias("correction_id"), "start", "end", original.alias("original"), "replacement", F.lit(0.95).alias("confidence"), F.lit("auto").alias("status"), "source")


def split_places(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, end, joined): places where a space may split a word."""
    rows = _each(docs, "start int, end int, left string, right string, whole string, short boolean", X.split_places)
    alone = lambda c: (F.length(c) > 1) | F.col(c).isin("a", "A", "I")
    fits = lambda k: ~(k["left"] & alone("left") & k["right"] & alone("right")) & (F.col("short") | k["whole"] & (F.length("whole") > 2))
    return _where_known(rows, lexicon, fits, ("left", "right", "whole")).select("doc_id", "start", "end", F.col("whole").alias("joined"))


def joined_words(places: DataFrame, answers: DataFrame, taken: DataFrame) -> DataFrame:
    """Corrections for the places that ``answers`` (doc_id, start) say are one word, unless ``taken`` (doc_id, start, end) has them."""
    from .links import without_overlap

    free = without_overlap(places, taken, ["doc_id"])
    yes = free.join(answers.select("doc_id", "start").distinct(), ["doc_id", "start"], "left_semi")
    return yes.select("doc_id", F.concat(F.lit("split-"), F.col("start").cast("string")).alias("correction_id"), "start", "end", F.col("joined").alias("replacement"), F.lit(0.9).alias("confidence"), F.lit("auto").alias("status"))
