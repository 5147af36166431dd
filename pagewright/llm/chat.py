"""Reply trees to formatted conversations.

A table of messages with parents is a forest of reply trees. Iterative self-joins
double every message's jump towards its root, which gives depth and summed score in a
number of rounds logarithmic in the deepest path; the leaves, which are the branches'
ends, are ranked within their tree by mean score, and only the chosen paths are
expanded, by the same jumps. Each path is one conversation.

A conversation is formatted turn by turn, so its size is not bounded by memory:
``pieces`` in order, put together, are the formatted text. A turn is

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

with ``&``, ``<`` and ``[`` in texts and roles (and line ends in roles) written as
character references, so that no control string can come from a text, and what was
written can be read back exactly. The loss mask covers the assistant's texts.

Scale: the self-joins are on (tree, message), which is unique, so that a large tree is
spread over all tasks. Only the last step needs a conversation's turns in order; it
streams over a sorted partition and holds one turn at a time.

Defined cases: a null text is empty, a null role too; a null tree id is a tree of its
own; messages whose parent isn't there are roots; a cycle is an error; repeated rows
of a conversation are turns like others; turns that tie are ordered by role and
text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import arrow_rows, materialise

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def unescape(text: str) -> str:
    return text.replace("&#10;", "\n").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the text begins and ends."""
    head = f"{START}{escape(role).replace(chr(10), '&#10;')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, text = _TURN.fullmatch(START + part).groups()
        turns.append((unescape(role), unescape(text)))
    return turns


def tree_key(col: Column) -> Column:
    """A text that is never null."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    return out


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, node, place) for the ``top`` best branches of each tree.

    ``nodes`` has tree (text), node (unique in its tree), parent (null at a root) and
    score. Branches are ranked by mean score, then by length, then by their leaf.
    """
    state = materialise(
        nodes.select("tree", "node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "jumps"
    )
    known = state
    levels: list[DataFrame] = []
    most = state.count()
    # those that have reached their root wait in ``done``; a round joins only the others
    done, state = state.where("jump is null"), state.where("jump is not null")
    while not state.isEmpty():
        if 1 << len(levels) > 2 * most:
            raise ValueError("the replies have a cycle")
        a, b = state.alias("a"), done.unionAll(state).alias("b")
        state = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.jump") == F.col("b.node")), "left").select(
            "a.tree",
            "a.node",
            F.when(F.col("b.node").isNotNull(), F.col("a.jump")).alias("via"),  # what the level's jump reaches
            F.col("b.jump").alias("jump"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"),
        )
        state = materialise(state, "jumps")
        levels.append(state.where("via is not null").select("tree", "node", "via"))
        state = state.drop("via")
        done, state = done.unionAll(state.where("jump is null")), state.where("jump is not null")
    state = done
    leaves = state.alias("a").join(known.where("jump is not null").alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.node") == F.col("b.jump")), "left_anti")
    best = W.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), F.col("node"))
    paths = leaves.withColumn("path", F.row_number().over(best)).where(F.col("path") <= top).select("tree", "path", "node")
    paths = materialise(paths, "paths")
    for level in reversed(levels):
        further = paths.alias("a").join(level.alias("b"), _same("tree", "node")).select("a.tree", "a.path", F.col("b.via").alias("node"))
        paths = materialise(paths.unionAll(further), "paths")
    return paths.alias("a").join(state.alias("b"), _same("tree", "node")).select("a.tree", "a.path", "a.node", F.col("b.depth").alias("place"))


def turns(rows: DataFrame, tree_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A conversation's rows as a reply tree: each turn replies to the one before."""
    rows = rows.select(tree_key(F.col(tree_col)).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    rows = rows.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    return rows.select("tree", "node", "parent", "role", "text", F.length("text").cast("double").alias("score"))


def pieces(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, place, piece, loss_start, loss_end), sorted within partitions; loss_* are null without loss.

    ``messages`` has tree, node, parent, role, text and score. Each partition holds
    whole conversations, turn after turn.
    """
    messages = materialise(messages, "messages")
    chosen = best_paths(messages, top)
    rows = chosen.alias("a").join(messages.alias("b"), _same("tree", "node")).select("a.tree", "a.path", "a.place", "b.role", "b.text")
    rows = rows.repartition("tree", "path").sortWithinPartitions("tree", "path", "place")
    out = T.StructType.fromDDL("tree string, path int, place long, piece string, loss_start int, loss_end int")
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                held = []
                for tree, path, place, role, text in zip(*(c.to_pylist() for c in b.slice(k, 1024).columns)):
                    made, s, e = piece(role, text)
                    held.append((tree, path, place, made, *((s, e) if role == "assistant" else (None, None))))
                yield arrow_rows(held, arrow)

    return rows.mapInArrow(run, out)


def digests(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What each conversation holds, read back from its formatted pieces."""
    kind = dict(rows.dtypes)[tree_col]
    out = T.StructType.fromDDL("tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        n = loss = chars = 0
        turned, masked = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            for tree, made, s, e in zip(*(c.to_pylist() for c in b.select(["tree", "piece", "loss_start", "loss_end"]).columns)):
                if tree != at:
                    if at is not None:
                        held.append((at, n, turned.hexdigest(), loss, masked.hexdigest(), chars))
                    if len(held) >= 1024:
                        yield arrow_rows(held, arrow)
                        held = []
                    at, n, loss, chars = tree, 0, 0, 0
                    turned, masked = hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(made):
                    n += 1
                    turned.update(f"{role}\n{text}\n".encode())
                chars += len(made)
                if s is not None:
                    text = unescape(made[s:e])
                    loss += len(text)
                    masked.update(text.encode())
        if at is not None:
            held.append((at, n, turned.hexdigest(), loss, masked.hexdigest(), chars))
        if held:
            yield arrow_rows(held, arrow)

    found = pieces(turns(rows, tree_col, turn_col, role_col, text_col)).mapInArrow(run, out)
    tree = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.expr("substring(tree, 2)")).cast(kind)
    return found.select(tree.alias(tree_col), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def assembled(made: DataFrame) -> DataFrame:
    """(tree, path, formatted) from pieces, for conversations that fit a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
    return made.groupBy("tree", "path").agg(F.array_join(parts, "").alias("formatted"))
