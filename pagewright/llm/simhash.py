"""SimHash near-duplicates by a self-join of binary tries.

Every text gets a 64-bit fingerprint. Two fingerprints are linked if they differ
in at most ``max_bits`` bits, and a component of links is one group of copies.

The links come from a trie self-join: two nodes of one level are visited
together, the bits in which their paths differ are added up, and a pair is left
as soon as it has more than ``max_bits``. To spread this over a cluster, the 64
bits are cut into ``max_bits + 2`` blocks. Two fingerprints within the budget
agree in at least two whole blocks, so for each choice of two blocks there is one
trie in whose bit order those blocks come first. Its top levels are walked by
the shuffle (only equal nodes can meet there) and the levels below by the task
that holds the subtree. A subtree of more than ``subtree_limit`` fingerprints is
not given to one task: its node pairs are walked eight levels further as rows of
a table, as often as needed, until each pair of nodes is small enough. Nothing
is dropped, and no pair is found twice, since a pair counts only in the first
order in which both blocks agree.

Defined cases: a null or empty text has the fingerprint zero, which is linked
like any other; repeated rows are kept, each with the same component; a null
doc_id keeps its row and is passed over when the smallest doc_id is taken (null,
if the component has none); an empty table gives an empty result; columns other
than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import map_rows, materialise, met, named, slices
from .components import components

BITS = 64
#: Levels that a pair of nodes in a too large subtree is walked on at once.
STEP = 8
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the ``width``-word shingles, repeats included (unsigned)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(words) - width + 1
    starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[width - 1 :].tolist(), len(joined)]
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, f"id {kind}, fp long", lambda: lambda i, text: [(i, signed(fingerprint(text, width)))])


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block, from the highest."""
    n = max_bits + 2
    cuts = [BITS - BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for hi, lo in zip(cuts, cuts[1:])]


def _part(fp, block: tuple[int, int]):
    lo, width = block
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))


def _orders(max_bits: int) -> list[tuple[list, list]]:
    """For each bit order: the two blocks that come first, and the others."""
    blocks = _blocks(max_bits)
    return [([blocks[i], blocks[j]], [b for k, b in enumerate(blocks) if k not in (i, j)]) for i, j in combinations(range(len(blocks)), 2)]


def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """A row for each fingerprint and bit order: the subtree it is in, and its path there."""

    def path(blocks):
        out = F.lit(0).cast("long")
        for b in blocks:
            out = F.shiftleft(out, b[1]).bitwiseOR(_part(F.col("fp"), b))
        return out

    rows = [
        F.struct(F.lit(o).alias("o"), path(top).alias("top"), path(rest).alias("rest"), F.lit(sum(b[1] for b in rest)).alias("left"))
        for o, (top, rest) in enumerate(_orders(max_bits))
    ]
    zero = F.lit(0).cast("long")
    return distinct.select("fp", F.explode(F.array(*rows)).alias("r")).select(
        "r.o", "r.top", zero.alias("pa"), zero.alias("pb"), F.lit(0).alias("acc"), F.lit(0).alias("side"), "r.left", "r.rest", "fp"
    )


NODE = ["o", "top", "pa", "pb", "acc"]


def _deeper(rows: DataFrame, max_bits: int) -> DataFrame:
    """The rows of too large node pairs, dealt to the pairs of nodes some levels below."""
    step = F.least(F.lit(STEP), F.col("left"))
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << STEP) if m.bit_count() <= max_bits))
    rows = rows.withColumn("step", step).withColumn("own", F.expr("shiftrightunsigned(rest, left - step)")).withColumn("mask", F.explode(masks))
    rows = rows.where(f"bit_count(mask) + acc <= {max_bits} and shiftrightunsigned(mask, step) = 0")
    other = F.col("own").bitwiseXOR(F.col("mask"))
    first = F.when(F.col("side") == 0, F.col("own") <= other).otherwise(F.col("side") == 1)
    side = F.when((F.col("side") == 0) & (F.col("mask") == 0), 0).otherwise(F.when(first, 1).otherwise(2))
    grown = lambda p, x: F.expr(f"shiftleft({p}, step)").bitwiseOR(x)
    return rows.select(
        "o",
        "top",
        grown("pa", F.when(first, F.col("own")).otherwise(other)).alias("pa"),
        grown("pb", F.when(first, other).otherwise(F.col("own"))).alias("pb"),
        (F.col("acc") + F.bit_count("mask")).cast("int").alias("acc"),
        side.alias("side"),
        (F.col("left") - F.col("step")).cast("int").alias("left"),
        F.expr("rest & (shiftleft(1L, left - step) - 1L)").alias("rest"),
        "fp",
    )


def links(distinct: DataFrame, max_bits: int = 2, subtree_limit: int = 50_000) -> DataFrame:
    """(a, b) for each two different fingerprints of column ``fp`` within ``max_bits`` bits."""
    rows = materialise(_rooted(distinct, max_bits), "trie")
    found = None
    while True:
        large = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.max("left").alias("left")).where((F.col("n") > subtree_limit) & (F.col("left") > 0)).select(*NODE)
        large = materialise(large, "large")
        if large.isEmpty():
            break
        at = [rows[c].eqNullSafe(large[c]) for c in NODE]
        same = at[0]
        for x in at[1:]:
            same = same & x
        part = _walk(rows.join(large, same, "left_anti"), max_bits)
        found = part if found is None else found.unionAll(part)
        rows = materialise(_deeper(rows.join(large, same, "left_semi"), max_bits), "trie")
    part = _walk(rows, max_bits)
    return part if found is None else found.unionAll(part)


def _walk(rows: DataFrame, max_bits: int) -> DataFrame:
    firsts = [sum(((1 << w) - 1) << lo for lo, w in top) for top, _ in _orders(max_bits)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            count += b.num_rows
            if count >= CHUNK:
                x = np.concatenate(held, axis=1)
                # the last subtree may go on in the next batch
                last = int(np.flatnonzero((x[:5] != x[:5, -1:]).any(axis=0))[-1:].sum()) + 1 if (x[:5] != x[:5, -1:]).any() else 0
                if last:
                    yield from _found(x[:, :last])
                held, count = [x[:, last:]], x.shape[1] - last
        if count:
            yield from _found(np.concatenate(held, axis=1))

    def _found(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in trie_pairs(x, max_bits):
            fp, o = x[8].view(np.uint64), x[0][i]
            differ = fp[i] ^ fp[j]
            keep = np.ones(len(i), bool)
            for k, mask in enumerate(firsts):  # the first order that finds this pair
                keep &= ~((o > k) & ((differ & np.uint64(mask)) == 0))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[8][i[keep]]), pa.array(x[8][j[keep]])], names=["a", "b"])

    dealt = rows.repartition(*NODE).sortWithinPartitions(*NODE, "side", "rest")
    return dealt.mapInArrow(run, "a long, b long")


def trie_pairs(x: np.ndarray, max_bits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows within the budget; ``x`` is sorted by node pair, side and path.

    A node is a range of rows. All pairs of nodes of one level go to the next level
    together; what is over ``most`` pairs waits on a stack.
    """
    n = x.shape[1]
    rest = x[7].astype(np.uint64)
    new = np.ones(n, bool)
    new[1:] = (x[:5, 1:] != x[:5, :-1]).any(axis=0)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    twos = np.concatenate([[0], np.cumsum(x[5] == 2)])
    split = hi - (twos[hi] - twos[lo])  # where the second side begins
    alone = x[5][lo] == 0
    la, ha, lb, hb = lo, np.where(alone, hi, split), np.where(alone, lo, split), hi
    depth = x[6][lo]
    for left in np.unique(depth):
        at = depth == left
        stack = [(int(left), la[at], ha[at], lb[at], hb[at], x[4][lo[at]])]
        zeros = {}
        while stack:
            bit, a0, a1, b0, b1, acc = stack.pop()
            full = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
            a0, a1, b0, b1, acc = (v[full] for v in (a0, a1, b0, b1, acc))
            if not len(a0):
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if bit == 0:
                single[:] = True
            if single.any():  # both have one path left: its differing bits at once
                i, j = a0[single], b0[single]
                low = np.uint64((1 << bit) - 1)
                near = acc[single] + np.bitwise_count((rest[i] ^ rest[j]) & low) <= max_bits
                if near.any():
                    yield i[near], j[near]
                a0, a1, b0, b1, acc = (v[~single] for v in (a0, a1, b0, b1, acc))
                if not len(a0):
                    continue
            if len(a0) > most:
                half = len(a0) // 2
                stack += [(bit, *(v[half:] for v in (a0, a1, b0, b1, acc))), (bit, *(v[:half] for v in (a0, a1, b0, b1, acc)))]
                continue
            bit -= 1
            if bit not in zeros:
                zeros[bit] = np.concatenate([[0], np.cumsum((rest >> np.uint64(bit)) & np.uint64(1) == 0)])
            z = zeros[bit]
            am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
            two = a0 != b0  # of one node with itself, (1, 0) is (0, 1) again
            room = acc < max_bits
            parts = [(a0, am, b0, bm, acc), (am, a1, bm, b1, acc)]
            parts.append(tuple(v[room] for v in (a0, am, bm, b1, acc + 1)))
            both = room & two
            parts.append(tuple(v[both] for v in (am, a1, b0, bm, acc + 1)))
            stack.append((bit, *(np.concatenate(v) for v in zip(*parts))))


def classes(prints: DataFrame, max_bits: int, subtree_limit: int) -> DataFrame:
    """(fp, root) for each fingerprint of ``prints``; root stands for its component."""
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    roots = components(links(distinct, max_bits, subtree_limit), "a", "b")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, subtree_limit: int = 50_000) -> DataFrame:
    """One row of each component, that of the smallest id (null is last), with the columns it had."""
    kept = [T.StructField("doc", T.StructType([f for f in docs.schema if f.name != text_col]))]
    out = T.StructType([*kept, *T.StructType.fromDDL("text string, row long, fp long")])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            prints = [signed(fingerprint(text, width)) for text in b.column(1).to_pylist()]
            columns = [*b.columns, pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(prints, pa.int64())]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = materialise(docs.select(F.struct(*(named(c) for c in docs.columns if c != text_col)).alias("doc"), named(text_col).alias("text")).mapInArrow(run, out), "printed")
    ids = rows.select(F.col("doc").getField(id_col).alias("id"), "row", "fp")
    first = ids.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    firsts = first.join(classes(rows, max_bits, subtree_limit), "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = rows.join(firsts.select(F.col("first.row").alias("row")), "row", "left_semi")
    return chosen.select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, subtree_limit: int = 50_000) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = materialise(least.join(classes(prints, max_bits, subtree_limit), "fp"), "classes")
    ids = materialise(found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "ids")
    by_print = materialise(met(found, ids, "root", "prints").select("fp", "component_id", "n"), "by-print")
    rows = met(prints, by_print, "fp", "n")  # texts without words all have one fingerprint
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
