"""Near copies by an exact Jaccard similarity of word shingles.

Two texts are linked if the sets of their ``width``-word shingles have a Jaccard
similarity of ``similarity`` or more; a component of links is one group of copies.
Every link is checked with both whole sets. Candidates come from two sides:

- ``BANDS`` bands of ``ROWS`` minimum hashes each: texts that agree in a band meet. A
  pair at 0.8 misses every band with a probability of (1 - 0.8 ** 5) ** 32 = 3e-6.
- SimHash fingerprints of the same shingles within ``max_bits`` bits (``simhash``).

Texts with the same set are one node, so exact copies add no pairs, and no bucket emits
all its pairs. First, in a band's bucket each node meets one pivot, another one in each
bucket; a node keeps the ``PIVOTS`` likeliest of them, by the share of minimum hashes in
which both agree (a sketch of a byte each), and the second step has the others. What these
links join is one component from then on. Second, in the buckets that still hold several
components, each node outside the bucket's largest component is compared with all others by
the sketches, in numpy, and the ``LIKELIEST`` of each other component are checked. A bucket
in which some were left over is compared again with what is linked by then, and ``GROWTH``
times as many are checked, until none is left over: in the end every candidate of two
components has been checked. Pairs whose sets can't be as similar, by ``MARKS`` bits of each
and their sizes, are none: that bound is exact, and most near misses fail it. A pair at 0.8 is below the least agreement asked for with a
probability of about 1e-5. Nodes of one fingerprint, and of two linked ones, are buckets
like those of bands. Buckets are cut into blocks of ``BLOCK`` nodes, so that no task holds
more, and a large group of copies, which is one component by then, is read once for each
block of the others.

Defined cases: null and empty texts have the same empty set, and are copies of each
other; a shorter text is one shingle; repeated rows are copies; a null id is last when
the smallest is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from . import simhash
from ._shared import materialise, named, slices
from ._shared import met as _met
from .components import components

BANDS, ROWS = 32, 5
CHUNK = 2048
#: Of BANDS * ROWS minimum hashes, as many as have to agree in a candidate.
AGREE = round(0.66 * BANDS * ROWS)
#: Of a node's pivots, and of another component's candidates, as many are checked first; the others come in later rounds.
PIVOTS, LIKELIEST, GROWTH = 4, 3, 16
BLOCK = 8192
#: Bits of a sketch that stand for the set.
MARKS = 1024
#: Nodes whose texts are looked up by a broadcast; more are joined.
SENT = 1 << 20
_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The hashes of the ``width``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(len(words) - width, 0) + 1
    return np.fromiter((digest(b" ".join(words[k : k + width]), seed) for k in range(n)), np.uint64, n)


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), CHUNK):
        np.minimum(least, (x[k : k + CHUNK] * _FACTORS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A signed key for each band of minimum hashes."""
    return [simhash.signed(xxhash.xxh64_intdigest(r.tobytes(), b)) for b, r in enumerate(least.reshape(BANDS, ROWS))]


def sketch(least: np.ndarray, found: np.ndarray) -> bytes:
    """A byte of each minimum hash, from the middle, where the factors have mixed the bits; the set as MARKS bits; its size."""
    marks = np.zeros(MARKS, bool)
    marks[(found % np.uint64(MARKS)).astype(np.int64)] = True
    return (least >> np.uint32(12)).astype(np.uint8).tobytes() + np.packbits(marks).tobytes() + np.int64(len(found)).tobytes()


def possible(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of two sketches, row by row, can be as similar as asked for.

    Each bit that one set has and the other hasn't is a shingle that isn't in both, at least.
    """
    p, q = (np.ascontiguousarray(x[:, BANDS * ROWS : -8]).view(np.uint64) for x in (one, two))
    m, n = (np.ascontiguousarray(x[:, -8:]).view(np.int64)[:, 0] for x in (one, two))
    both = np.minimum(m - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), n - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
    return both >= similarity * (m + n - both) - 1e-9


def _checked(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, [np.zeros(0, np.uint64)] * 2
        for rows in slices(batches):
            a, b, keep = rows.column(0).to_pylist(), rows.column(1).to_pylist(), []
            for k in range(rows.num_rows):
                if a[k] != last:
                    last, sets[0] = a[k], np.unique(hashes(rows.column(2)[k].as_py(), width))
                sets[1] = np.unique(hashes(rows.column(3)[k].as_py(), width))
                small, large = sorted(map(len, sets))
                if small >= similarity * large - 1e-9:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    if both >= similarity * (small + large - both) - 1e-9:
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.int64()) for x in (a, b)], names=["a", "b"])

    first, second = texts.select(F.col("key").alias("a"), F.col("text").alias("one")), texts.select(F.col("key").alias("b"), F.col("text").alias("two"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "one", "two")
    return materialise(both.mapInArrow(run, "a long, b long"), "checked", texts=True)


def _texts(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, text) of one row for each node of the pairs."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    needed = materialise(firsts.join(keys, "key", "left_semi").select("row"), "needed")
    if needed.count() <= SENT:
        needed = F.broadcast(needed)
    return materialise(rows.join(needed, "row", "left_semi").select("key", "text"), "texts")


def _pairs(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _sketched(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with the number of minimum hashes in which they agree, if it is AGREE or more and the similarity possible."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, two = (_matrix(b.column(k)) for k in (2, 3))
                agree = (one[:, : BANDS * ROWS] == two[:, : BANDS * ROWS]).sum(axis=1)
                keep = pa.array((agree >= AGREE) & possible(one, two, similarity))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(agree.astype(np.int32)).filter(keep)], names=["a", "b", "agree"])

    first, second = (nodes.select(F.col("key").alias(x), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "a_sketch", "b_sketch")
    return both.mapInArrow(run, "a long, b long, agree int")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS + MARKS // 8 + 8)


def likely(asking: np.ndarray, ask_root: np.ndarray, others: np.ndarray, other_root: np.ndarray, most: int, similarity: float) -> Iterator[tuple[int, int, bool]]:
    """(place asking, place among others, whether some are left over) of the ``most`` likeliest of each other component, by the sketches."""
    hashed = BANDS * ROWS
    step = max(1, (1 << 25) // max(1, len(others) * hashed))
    for at in range(0, len(asking), step):
        agree = (asking[at : at + step, None, :hashed] == others[None, :, :hashed]).sum(axis=2, dtype=np.int32)
        agree[ask_root[at : at + step, None] == other_root[None, :]] = 0
        i, j = np.nonzero(agree >= AGREE)
        if len(i):
            able = np.concatenate([possible(asking[at + i[k : k + CHUNK]], others[j[k : k + CHUNK]], similarity) for k in range(0, len(i), CHUNK)])
            i, j = i[able], j[able]
        if len(i):
            order = np.lexsort((j, -agree[i, j], other_root[j], i))
            i, j = i[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (other_root[j[1:]] != other_root[j[:-1]])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(i)))
            rank, over = np.arange(len(i)) - np.repeat(first, n), np.repeat(n, n) > most
            taken = rank < most
            yield from zip((i[taken] + at).tolist(), j[taken].tolist(), over[taken].tolist())


def _across(met: DataFrame, nodes: DataFrame, roots: DataFrame, block: int, most: int, similarity: float) -> DataFrame:
    """Likely pairs (band, a, b, over) of nodes of one bucket and different components; from (band, key).

    ``over`` says that a node has more than ``most`` candidates in the other component.
    """
    held = materialise(met.join(roots, met["key"] == roots["node"], "left").select("band", "key", F.coalesce("root", "key").alias("root")), "held")
    by_root = held.groupBy("band", "root").agg(F.count("*").alias("n"))
    buckets = by_root.groupBy("band").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most")).where("n > most")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")
    buckets = materialise(buckets.select("band", "main", parts(F.col("n")).alias("blocks"), parts(F.col("n") - F.col("most")).alias("askers")), "mixed")
    rows = held.join(buckets, "band").join(nodes.select("key", "sketch"), "key")
    of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ["key", "root", "sketch"]
    asking = rows.where("root <> main").select("band", of("askers").alias("i"), each("blocks").alias("j"), F.lit(0).alias("side"), *shown)
    others = rows.select("band", each("askers").alias("i"), of("blocks").alias("j"), F.lit(1).alias("side"), *shown)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def found(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
            side, key, root, sketches = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy(), _matrix(rows.column(6))
            band = rows.column(0).to_numpy()
            bands, a, b, over = [], [], [], []
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                split = lo + int((side[lo:hi] == 0).sum())
                for x, y, more in likely(sketches[lo:split], root[lo:split], sketches[split:hi], root[split:hi], most, similarity):
                    bands.append(band[lo])
                    a.append(key[lo + x])
                    b.append(key[split + y])
                    over.append(more)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (bands, a, b)), pa.array(over, pa.bool_())], names=["band", "a", "b", "over"])

        for batch in batches:
            rest.append(batch)
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if sum(x.num_rows for x in rest) else batch
            groups = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
            edges = np.flatnonzero(np.append(True, (groups[:, 1:] != groups[:, :-1]).any(axis=0))) if rows.num_rows else np.zeros(0, np.int64)
            if len(edges) > 1:  # the last bucket may go on in the next batch
                yield found(rows.slice(0, int(edges[-1])), edges)
                rest = [rows.slice(int(edges[-1]))]
            elif rows.num_rows:
                rest = [rows]
        if rest and rest[0].num_rows:
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            yield found(rows, np.array([0, rows.num_rows]))

    dealt = asking.unionAll(others).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side")
    return dealt.mapInArrow(run, "band long, a long, b long, over boolean").select("band", *_pairs(F.col("a"), F.col("b")), "over")


def _by_print(nodes: DataFrame, linked: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key) of nodes of one fingerprint, or of two linked ones, that are more than those already compared and of several components."""
    rooted = nodes.join(roots, nodes["key"] == roots["node"], "left").select("fp", "key", F.coalesce("root", "key").alias("root"))
    of_print = rooted.groupBy("fp").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    of_print = materialise(of_print, "prints")
    same = of_print.where("n > 2 and lo <> hi").select("fp", F.xxhash64("fp").alias("band"))
    one, two = (of_print.select(*(F.col(c).alias(f"{x}_{c}" if c != "fp" else x) for c in of_print.columns)) for x in "ab")
    several = linked.join(one, "a").join(two, "b").where("a_n + b_n > 2 and greatest(a_hi, b_hi) <> least(a_lo, b_lo)")
    several = several.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("band"))
    return nodes.select("fp", "key").join(same.unionAll(several), "fp").select("band", "key")


def links(rows: DataFrame, firsts: DataFrame, width: int, similarity: float, max_bits: int, block: int = BLOCK) -> DataFrame:
    """(a, b) that join the nodes of each component; from (row, text, key, fp, sketch, bands) and (key, row)."""
    nodes = materialise(rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("fp", "sketch", "bands"))), "nodes")
    met = nodes.select(F.explode("bands").alias("band"), "key")
    # key xor band orders a bucket's nodes, and differently in each bucket
    pivot = met.groupBy("band").agg(F.count("*").alias("n"), F.min(F.col("key").bitwiseXOR(F.col("band"))).alias("least")).where("n > 1")
    pivot = materialise(pivot.select("band", F.col("least").bitwiseXOR(F.col("band")).alias("pivot"), "n"), "pivots")
    met = materialise(_met(met, pivot, "band", "n"), "met")
    by_pivot = met.where("key <> pivot").select("key", "pivot").distinct()
    likeliest = F.row_number().over(W.partitionBy("a").orderBy(F.col("agree").desc(), "b"))
    near = _sketched(by_pivot.select(F.col("key").alias("a"), F.col("pivot").alias("b")), nodes, similarity)
    near = near.withColumn("place", likeliest).where(F.col("place") <= PIVOTS).select(*_pairs(F.col("a"), F.col("b")))
    # by SimHash: a node of each fingerprint stands for it, the others of one fingerprint meet it
    least = materialise(nodes.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "least")
    same = _met(nodes.select("fp", "key"), least, "fp", "n").where("key <> least").select(*_pairs(F.col("key"), F.col("least")))
    linked = materialise(simhash.links(least.select("fp"), max_bits), "linked")
    one, two = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_key")) for x in "ab")
    least_linked = linked.join(one, "a").join(two, "b").select(*_pairs(F.col("a_key"), F.col("b_key")))
    close = _sketched(same.unionAll(least_linked), nodes, similarity).select("a", "b")
    pairs = materialise(near.unionAll(close).distinct(), "pairs")
    found = _checked(pairs, _texts(rows, firsts, pairs), width, similarity)

    roots = materialise(components(found, "a", "b"), "roots")
    star = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    met, most = met.select("band", "key").unionAll(_by_print(nodes, linked, roots)), LIKELIEST
    while True:
        likeliest = materialise(_across(met, nodes, roots, block, most, similarity), "likeliest")
        more = materialise(likeliest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        new = None if more.isEmpty() else _checked(more, _texts(rows, firsts, more), width, similarity)
        found = star() if new is None else star().unionAll(new)
        over = likeliest.where("over").select("band").distinct()
        if over.isEmpty():
            return found
        met, pairs, most = materialise(met.join(over, "band", "left_semi"), "met"), pairs.unionAll(more), most * GROWTH
        if new is not None and not new.isEmpty():
            roots = materialise(components(found, "a", "b"), "roots")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """One row of each component, that of the smallest id (null is last), with the columns it had."""
    kept = [T.StructField("doc", T.StructType([f for f in docs.schema if f.name != text_col]))]
    out = T.StructType([*kept, *T.StructType.fromDDL("text string, row long, key long, fp long, sketch binary, bands array<long>")])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            keys, prints, sketches, held = [], [], [], []
            for text in b.column(1).to_pylist():
                found = hashes(text, width)
                ones = np.zeros(simhash.BITS, np.int64)
                for k in range(0, len(found), simhash.CHUNK):
                    ones += np.unpackbits(found[k : k + simhash.CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                prints.append(simhash.signed(int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")))
                found = np.unique(found)
                keys.append(simhash.signed(xxhash.xxh64_intdigest(found.tobytes())))
                least = minima(found)
                sketches.append(sketch(least, found))
                held.append(bands(least))
            columns = [*b.columns, pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), pa.array(held, arrow.field("bands").type)]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = materialise(docs.select(F.struct(*(named(c) for c in docs.columns if c != text_col)).alias("doc"), named(text_col).alias("text")).mapInArrow(run, out), "printed", texts=True)
    ids = rows.select(F.col("doc").getField(id_col).alias("id"), "row", "key")
    firsts = materialise(ids.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select("key", "first", "first.row"), "firsts")
    roots = components(links(rows, firsts, width, similarity, max_bits), "a", "b")
    groups = firsts.join(roots, firsts["key"] == roots["node"], "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    chosen = rows.join(groups.select(F.col("first.row").alias("row")), "row", "left_semi")
    return chosen.select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))
