"""Exact top-k search by inner product with no-random-access aggregation.

Every component is a list of the candidates sorted by its value. All lists are read
in step from both ends, so that an entry not read yet lies between the last values
read. That bounds each candidate's score from below and above; reading stops when a
query's k-th best lower bound is above what an unseen candidate could reach and only
few candidates have an upper bound at or above it. Their final scores are resolved,
and only then. Scores are integers, so results are exact.

Scale: the queries are a stated set, taken against all rows in blocks. A block of
``query_block`` queries, a bounded number, is sent to all tasks; each task reads its
candidates where they are, ``row_block`` at a time, and keeps each query's k best. The
k-th best score so far goes from block to block, so that later blocks stop sooner. Only
the k best of each task and query are shuffled. The next block of queries is a job of
its own; nothing is held for two blocks at once. The bounds of a block are matrix
products, as all its queries read to the same depth.

Defined cases: vectors that are null or hold null or non-finite components and rows
without an id take no part; equal rows are rows like others, each a candidate and, if its
id is divisible, a query; a query meets only vectors of its own length, and all but its
own row; ties go to the smaller id; an empty table gives an empty result; other columns
are not read; a score that a long can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialise

#: Parts of the lists read after each round, from each end.
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2)
#: Queries whose bounds are held at once.
TOGETHER = 256
FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component; null if the vector or a component isn't finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def aggregate(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray | None = None, depths: tuple[float, ...] = DEPTHS) -> tuple[list[np.ndarray], float]:
    """For each query, the rows that can be among its k best, and the part of the lists that was read.

    ``own`` (rows x queries) are left out. ``bar`` has for each query a score that k other
    rows are known to reach, or None where there is none.
    """
    n, width = rows.shape
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(width, 1)
    # numbers in which the bounds are exact
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object
    bar = np.full(len(queries), -largest - 1, object) if bar is None else bar
    bar = np.maximum(bar, -largest - 1).astype(kind)
    lists = np.argsort(rows, axis=0, kind="stable")
    place = np.empty_like(lists)
    np.put_along_axis(place, lists, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(rows, lists, axis=0)
    up, down = np.maximum(queries, 0).astype(kind).T, np.minimum(queries, 0).astype(kind).T
    signed = queries.astype(kind).T
    able, part = ~own, 0.0
    for part in depths if width else ():
        read = min(max(int(np.ceil(n * part)), 1), (n + 1) // 2)
        seen = (place < read) | (place >= n - read)
        least, most = ordered[read - 1].astype(kind), ordered[n - read].astype(kind)
        known = np.where(seen, rows, 0).astype(kind) @ signed
        hidden = (~seen).astype(kind)
        upper = known + (hidden * most) @ up + (hidden * least) @ down
        lower = known + (hidden * least) @ up + (hidden * most) @ down
        if n >= k:
            reached = np.sort(np.where(own, -largest - 1, lower), axis=0)[n - k] if kind is object else np.partition(np.where(own, kind(-largest - 1), lower), n - k, axis=0)[n - k]
            bar = np.maximum(bar, reached)
        able = (upper >= bar) & ~own
        outsiders = most @ up + least @ down
        if seen.all() or ((outsiders < bar).all() or seen.any(axis=1).all()) and able.sum() <= len(queries) * max(4 * k, n // 32):
            break
    return [np.flatnonzero(able[:, q]) for q in range(len(queries))], 2 * part


class Best:
    """The k best rows of each query among the blocks seen so far."""

    def __init__(self, queries: np.ndarray, numbers: np.ndarray, k: int):
        self.queries, self.numbers, self.k = queries, numbers, k
        self.held: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), best first

    def add(self, rows: np.ndarray, numbers: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(self.queries), TOGETHER):
            part = self.queries[at : at + TOGETHER]
            bar = np.array([-held[-1][0] if len(held) == self.k else -(1 << 200) for held in self.held[at : at + TOGETHER]], object)
            able, _ = aggregate(part, rows, numbers[:, None] == self.numbers[None, at : at + TOGETHER], self.k, bar)
            for q, found in enumerate(able):
                if len(found):
                    score = _scores(rows[found], part[q])
                    self.held[at + q] = sorted([*self.held[at + q], *zip([-x for x in score], ids[found].tolist())])[: self.k]


def _scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(rows.shape[1], 1)
    if largest < 1 << 62:
        return (rows @ query).tolist()
    return [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]


def _matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, ids, vectors) of the rows of each length."""
    widths = table.column("width").to_numpy()
    for width in np.unique(widths):
        rows = table.filter(pa.array(widths == width))
        flat = pa.concat_arrays([c.flatten() for c in rows.column("vector").chunks]) if rows.num_rows else pa.array([], pa.int64())
        yield rows.column("row").to_numpy(), rows.column("id").to_numpy(), flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, int(width))


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, factor: float = 256.0, query_block: int = 8192, row_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), factor).alias("vector")).where("id is not null and vector is not null")
    vectors = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "vector", F.size("vector").alias("width")), "vectors")
    asked = vectors.where(F.col("id") % every == 0)
    n_query = -(-max(asked.count(), 1) // query_block)
    found = None
    for number in range(n_query):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_query)) == number).toArrow()
        sent = spark.sparkContext.broadcast({m.shape[1]: (m, numbers, ids) for numbers, ids, m in _matrices(block)})

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {width: Best(m, numbers, k) for width, (m, numbers, _) in sent.value.items()}
            held: list[pa.RecordBatch] = []

            def read() -> None:
                for numbers, ids, m in _matrices(pa.Table.from_batches(held)) if held else ():
                    for at in range(0, len(m), row_block) if m.shape[1] in best else ():
                        part = slice(at, at + row_block)
                        best[m.shape[1]].add(m[part], numbers[part], ids[part])

            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= row_block:
                    read()
                    held = []
            read()
            for width, of in best.items():
                _, numbers, ids = sent.value[width]
                out = [(q, i, v, -s) for q, i, x in zip(numbers.tolist(), ids.tolist(), of.held) for s, v in x]
                for at in range(0, len(out), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out[at : at + (1 << 16)])], names=["query", "query_id", "vec_id", "score"])

        rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
        part = vectors.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_query > 1:
            part = materialise(part, "best")
            sent.unpersist()
        found = part if found is None else found.unionAll(part)
    return found
