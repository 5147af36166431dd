"""Benchmark decontamination by a positional inverted index.

The index is distributed by documents: a task cuts the documents it holds into shards of
about a million words, and stores for every term of a shard the sorted list of its
positions (``build_index``, a written table of one row for each shard). A phrase is found
in a shard by intersecting its terms' lists, each moved back by the term's place in the
phrase, from the rarest term on. A proximity match is a place in one document where
all words of a window but ``misses`` stand within ``slack`` words of where they should;
its candidates come from the lists of the ``misses + 1`` rarest terms, one of which every
match must hold. Only a shard's own lists have to meet, so that no list of a frequent
term is ever gathered from the corpus, and a search reads every shard where it is
written, without a shuffle.

The items are searched in blocks of at most ``block`` words, whatever their number; a
further block is a further job, and nothing is held for two. No item and no document is cut.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in
lower case. A window is ``size`` consecutive words of an item; a shorter item is one
window, and matches as a phrase only. A document's word is hit if it is inside an
occurrence of a window, and near if it is inside a proximity match, which an
occurrence is too.

Defined cases: null and empty texts have no words and are not contaminated; items
without words match nothing; repeated documents each give a row, repeated items count
once for each item_id; an empty benchmark leaves every document clean; an empty
table of documents gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import arrow_rows, materialise, named, released, superseded

_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Words that a shard holds before it is searched.
SHARD = 1_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


class _Ids(dict):
    def __missing__(self, word):
        return -1


class Windows:
    """The windows of a block of items, over the terms they use."""

    def __init__(self, items: list[tuple], size: int):
        self.size, self.ids = size, _Ids()
        phrases: dict[tuple[int, ...], set] = {}
        for item, text in items:
            terms = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            for k in range(max(len(terms) - size, 0) + 1):
                if window := tuple(terms[k : k + size]):
                    phrases.setdefault(window, set()).add(item)
        self.phrases = list(phrases)
        self.items = [sorted(x, key=str) for x in phrases.values()]
        #: (numbers of the phrases, their terms as rows) by length
        self.by_length = []
        for n in sorted({len(p) for p in self.phrases}):
            of = [k for k, p in enumerate(self.phrases) if len(p) == n]
            self.by_length.append((np.array(of), np.array([self.phrases[k] for k in of], np.int64)))


class Index:
    """Sorted lists of positions by term, of documents that begin at ``begins``.

    A document's words are followed by one empty position; ``begins`` ends with where a
    further document would begin. All lists stand one after the other in one array, each
    position moved by its term, so that lists of many phrases are intersected at once.
    """

    def __init__(self, lists: dict[int, np.ndarray], n_terms: int, begins: np.ndarray):
        none = np.zeros(0, np.int64)
        found = [lists.get(t, none) for t in range(n_terms)]
        self.positions = np.concatenate([none, *found]).astype(np.int64)
        self.counts = np.array([len(x) for x in found], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.begins, self.span = begins, int(begins[-1]) + 1
        self.keys = self.positions + np.repeat(np.arange(n_terms, dtype=np.int64), self.counts) * self.span

    def has(self, terms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether each term has a position from its first to its last."""
        at = terms * self.span
        first, last = np.maximum(first, 0), np.minimum(last, self.span - 1)
        return np.searchsorted(self.keys, at + last, "right") > np.searchsorted(self.keys, at + first, "left")

    def _postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``terms``, position) of all positions of the terms."""
        n = self.counts[terms]
        of = np.repeat(np.arange(len(terms)), n)
        before = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        return of, self.positions[np.arange(len(of)) - before[of] + self.starts[terms][of]]

    def phrases(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of all occurrences: each list moved back by its offset, intersected from the rarest on."""
        order = np.argsort(self.counts[matrix], axis=1, kind="stable")
        rows = np.arange(len(matrix))
        of, at = self._postings(matrix[rows, order[:, 0]])
        at = at - order[of, 0]
        for r in range(1, matrix.shape[1]):
            j = order[of, r]
            left = self.has(matrix[of, j], at + j, at + j)
            of, at = of[left], at[left]
        return of, at

    def near(self, matrix: np.ndarray, slack: int, misses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, document) of all places that all terms of a row but ``misses`` are near to."""
        order = np.argsort(self.counts[matrix], axis=1, kind="stable")
        rows, out = np.arange(len(matrix)), []

        def left(of: np.ndarray, at: np.ndarray, d: np.ndarray, within: int) -> tuple[np.ndarray, ...]:
            missed = np.zeros(len(of), np.int64)
            for r in range(matrix.shape[1]):
                j = order[of, r]
                missed += ~self.has(matrix[of, j], np.maximum(at + j - within, self.begins[d]), np.minimum(at + j + within, self.begins[d + 1] - 2))
                keep = missed <= misses
                of, at, d, missed = of[keep], at[keep], d[keep], missed[keep]
            return of, at, d

        for r in range(min(misses + 1, matrix.shape[1])):
            of, at = self._postings(matrix[rows, order[:, r]])
            d = np.searchsorted(self.begins, at, "right") - 1
            # the term may be moved by the slack and the others too: twice the slack first, then each start
            of, at, d = left(of, at - order[of, r], d, 2 * slack)
            shift = np.arange(-slack, slack + 1)
            out.append(left(np.repeat(of, len(shift)), (at[:, None] + shift).ravel(), np.repeat(d, len(shift)), slack))
        return tuple(np.unique(np.concatenate([np.stack(x) for x in out], axis=1), axis=1))


class Hits:
    """What a document holds: ranges [start, end) of words and the items, of phrases and of proximity matches."""

    __slots__ = ("items", "near", "near_items", "ranges")

    def __init__(self):
        self.ranges, self.items, self.near, self.near_items = [], set(), [], set()


#: Positions of rarest terms that are followed at once.
TOGETHER = 1 << 18


def search(windows: Windows, index: Index, slack: int = 2, misses: int = 1) -> list[Hits]:
    """For each document of a shard, what is found in it."""
    begins = index.begins
    out = [Hits() for _ in begins[1:]]
    for numbers, matrix in windows.by_length:
        n, whole = matrix.shape[1], matrix.shape[1] == windows.size
        counts = np.sort(index.counts[matrix], axis=1)
        able = (counts == 0).sum(axis=1) <= (misses if whole else 0)
        numbers, matrix, counts = numbers[able], matrix[able], counts[able]
        size = np.cumsum(counts[:, : misses + 1].sum(axis=1) + 1)
        for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(size // TOGETHER)) + 1) if len(numbers) else ():
            of, at = index.phrases(matrix[part])
            d = np.searchsorted(begins, at, "right") - 1
            for p, start, k in zip(numbers[part[of]].tolist(), (at - begins[d]).tolist(), d.tolist()):
                out[k].ranges.append((start, start + n))
                out[k].items.update(windows.items[p])
                if not whole:
                    out[k].near.append((start, start + n))
                    out[k].near_items.update(windows.items[p])
            if whole:
                of, at, d = index.near(matrix[part], slack, misses)
                ends = begins[d + 1] - 1 - begins[d]
                for p, start, end, k in zip(numbers[part[of]].tolist(), (at - begins[d]).tolist(), ends.tolist(), d.tolist()):
                    out[k].near.append((max(start, 0), min(start + n, end)))
                    out[k].near_items.update(windows.items[p])
    return out


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> list[DataFrame]:
    """The items in blocks of about ``block`` words, by a hash of the id; usually one."""
    size = items.agg(F.sum(F.length(text_col) / 2 + 1)).first()[0] or 0
    n = max(1, -(-int(size) // block))
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return [rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


#: Parts in which a shard's terms are stored; a small benchmark reads only those that may hold its terms.
BUCKETS = 256
#: A row is a shard, so that the writer looks at its memory after every row.
_WRITTEN = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1"}


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class _Numbers(dict):
    """Words numbered as they come; a shard holds each word once, and numbers in the place of its repeats."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), np.int32)


def _shard(known: _Numbers, texts: list[np.ndarray]) -> tuple[bytes, list[dict]]:
    """The documents' numbers of words, and the lists of the shard's terms by bucket."""
    pack = zstandard.ZstdCompressor(level=1).compress
    lengths = np.array([len(t) for t in texts], np.int32)
    terms = np.concatenate(texts)
    place = np.arange(len(terms), dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    all_words = list(known)
    bucket = np.fromiter(map(_bucket, all_words), np.int64, len(all_words))
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(all_words), np.int32)
    rank[by_bucket] = np.arange(len(all_words))
    ranked = rank[terms]
    place = place[np.argsort(ranked, kind="stable")]
    counts = np.bincount(ranked, minlength=len(all_words)).astype(np.int32)
    edges = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1)).tolist()
    ends = np.concatenate([[0], np.cumsum(counts)])[edges].tolist()
    parts = []
    for k in range(BUCKETS):
        a, z = edges[k], edges[k + 1]
        if a < z:
            listed = np.diff(place[ends[k] : ends[k + 1]], prepend=np.int32(0))
            held = pack(b" ".join([all_words[i] for i in by_bucket[a:z].tolist()]))
            parts.append({"bucket": k, "terms": held, "counts": pack(counts[a:z].tobytes()), "positions": pack(listed.tobytes())})
    return pack(lengths.tobytes()), parts


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD) -> DataFrame:
    """The stored index: (shard, ids, lengths, parts), a row for each shard.

    A part holds the terms of a bucket, how often each stands in the shard, and their
    positions, term after term, as differences; all three are compressed. ``ids`` and
    ``lengths`` are the documents' ids and numbers of words.
    """
    ids = T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))
    parts = "lengths binary, parts array<struct<bucket int, terms binary, counts binary, positions binary>>"
    out = T.StructType([T.StructField("shard", T.LongType()), ids, *T.StructType.fromDDL(parts)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        known, ids, texts, count = _Numbers(), [], [], 0
        released()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(known.of(text.as_py()))
                count += len(texts[-1]) + 1
                if count >= shard_words:
                    yield arrow_rows([(shard, ids, *_shard(known, texts))], arrow)
                    shard, known, ids, texts, count = shard + 1, _Numbers(), [], [], 0
                    released()
        if texts:
            yield arrow_rows([(shard, ids, *_shard(known, texts))], arrow)

    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, out), "postings", texts=True, **_WRITTEN)


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", size: int = 10, slack: int = 2, misses: int = 1, block: int = 1_000_000) -> DataFrame:
    """(id, n_words, ranges, items, near, near_items) for each document of a stored index.

    ``ranges`` and ``near`` are the words hit by phrases and by proximity matches as ordered,
    disjoint [start, end); the items are strings, in order.
    """
    spots = "array<struct<s int, e int>>"
    found_in = f"n_words long, ranges {spots}, items array<string>, near {spots}, near_items array<string>"
    out = T.StructType([*T.StructType.fromDDL("shard long, place int"), T.StructField("id", index.schema["ids"].dataType.elementType), *T.StructType.fromDDL(found_in)])
    arrow = to_arrow_schema(out)
    found = None
    blocks = item_blocks(items, item_col, item_text, block)
    for part in blocks:
        asked = [tuple(r) for r in part.collect()]
        sent = index.sparkSession.sparkContext.broadcast(asked)
        needed = sorted({_bucket(w) for _, text in asked for w in words(text)})
        parts = F.filter("parts", lambda x: x["bucket"].isin(needed)) if len(needed) < BUCKETS else F.col("parts")  # noqa: B023
        hits = index.select("shard", "ids", "lengths", parts.alias("parts")).mapInArrow(_shard_searcher(sent, size, slack, misses, arrow), out)
        if len(blocks) > 1:
            hits = materialise(hits, "hits")
            sent.unpersist()
        found = hits if found is None else found.unionAll(hits)
    if len(blocks) > 1:
        both = found.groupBy("shard", "place").agg(
            F.first("id").alias("id"), F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "items", "near", "near_items"))
        )
        for c in ("ranges", "near"):
            both = both.withColumn(c, _merged_ranges(F.array_sort(c)))
        for c in ("items", "near_items"):
            both = both.withColumn(c, F.array_sort(F.array_distinct(c)))
        found = both
    return found.select("id", "n_words", "ranges", "items", "near", "near_items")


def _merged_ranges(ranges):
    def step(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        meets = (F.size(acc) > 0) & (r["s"] <= last["e"])
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ranges, F.slice(ranges, 1, 0), step)


def _shard_searcher(sent, size: int, slack: int, misses: int, arrow: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, size)
        unpack = zstandard.ZstdDecompressor().decompress
        held = lambda raw, kind=np.int32: np.frombuffer(unpack(raw), kind)
        for b in batches:
            for shard, ids, packed, parts in zip(*(b.column(k) for k in range(4))):
                shard, ids, lengths = shard.as_py(), ids.as_py(), held(packed.as_py()).astype(np.int64)
                lists: dict[int, np.ndarray] = {}
                for x in parts.as_py():
                    at = np.concatenate([[0], np.cumsum(held(x["counts"]), dtype=np.int64)])
                    there = np.cumsum(held(x["positions"]), dtype=np.int64)
                    for n, word in enumerate(unpack(x["terms"]).split(b" ")):
                        term = windows.ids.get(word)
                        if term is not None:
                            lists[term] = there[at[n] : at[n + 1]]
                found = search(windows, Index(lists, len(windows.ids), np.concatenate([[0], np.cumsum(lengths + 1)])), slack, misses)
                spots = lambda ranges: [{"s": s, "e": e} for s, e in merged(ranges)]
                rows = [
                    (shard, k, i, n, spots(x.ranges), sorted(map(str, x.items)), spots(x.near), sorted(map(str, x.near_items)))
                    for k, (i, n, x) in enumerate(zip(ids, lengths.tolist(), found))
                ]
                yield arrow_rows(rows, arrow)

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, n_words, ranges, items, near, near_items) for each document, by an index stored for it."""
    return search_index(build_index(docs, id_col, text_col), items, **how).withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", sent: int = 1 << 20, **how) -> DataFrame:
    """The documents without phrase and proximity matches, with all their columns.

    A text alone says whether it is contaminated, so the index has its MD5 for an id and
    the texts stay where they are: up to ``sent`` digests of contaminated texts, as
    counted, are broadcast; more of them meet the documents in an anti-join.
    """
    digest = F.md5(F.coalesce(named(text_col), F.lit("")))
    index = build_index(docs.select(digest.alias("digest"), named(text_col).alias("text")), "digest", "text")
    found = search_index(index, items, **how).where((F.size("ranges") > 0) | (F.size("near") > 0))
    bad = materialise(found.select(F.col("id").alias("__digest")).distinct(), "contaminated")
    superseded(index)
    few = bad.count() <= sent
    kept = docs.withColumn("__digest", digest).join(F.broadcast(bad) if few else bad, "__digest", "left_anti")
    return kept.drop("__digest")


def digests(docs: DataFrame, items: DataFrame, size: int = 10, block: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items) for each document, by a stored index."""
    found = search_index(build_index(docs), items, size=size, block=block).withColumnRenamed("id", "doc_id")
    count = lambda ranges: F.expr(f"aggregate({ranges}, 0L, (n, x) -> n + x.e - x.s)")
    return found.select(
        "doc_id",
        "n_words",
        count("ranges").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (count("ranges") > 0).alias("contaminated"),
        count("near").alias("n_near"),
        F.array_join("near_items", ",").alias("near_items"),
    )
