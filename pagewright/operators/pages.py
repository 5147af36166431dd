"""What a page's own task works out: order, pieces, paragraphs, captions. Pages are small, and each is one group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as X

BOX = ["x0", "y0", "x1", "y1"]
_KEY = "doc_id {kind}, page long, seq long"


def _by_page(rows: DataFrame, schema: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]
    return rows.withColumn("page", F.col("page").cast("long")).withColumn("seq", F.col("seq").cast("long")).groupBy("doc_id", "page").applyInPandas(make, f"{_KEY.format(kind=kind)}, {schema}")


def _boxes(page: pd.DataFrame) -> list[L.Box]:
    return list(page[BOX].itertuples(index=False, name=None))


def reading_order(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, place) of items with boxes."""

    def make(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq").reset_index(drop=True)
        order = L.reading_order(_boxes(page))
        return page.loc[order, ["doc_id", "page", "seq"]].assign(place=range(len(order)))

    return _by_page(items, "place int", make)


def pieces(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, piece, place): the piece of each item (text null: a picture; block_no, size), and the pieces' order by columns."""

    def make(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq").reset_index(drop=True)
        boxes, texts = _boxes(page), [t if isinstance(t, str) else None for t in page["text"]]
        groups = L.pieces(boxes, texts, page["block_no"].tolist(), page["size"].tolist())
        order = L.column_order(groups, boxes, texts, page["size"].tolist())
        rank = {g: k for k, g in enumerate(order)}
        piece = {i: n for n, g in enumerate(groups) for i in g}
        return page[["doc_id", "page", "seq"]].assign(piece=[piece[i] for i in range(len(page))], place=[rank[piece[i]] for i in range(len(page))])

    return _by_page(items, "piece int, place int", make)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, seq, para) of ordered lines (text, box, size, bold, gap)."""
    import re

    item = re.compile(X.LINE_CLASSES["list_item"])

    def make(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq").reset_index(drop=True)
        rows = [{"text": t, "box": b, "size": s, "bold": bool(w)} for t, b, s, w in zip(page["text"], _boxes(page), page["size"], page["bold"])]
        return page[["doc_id", "page", "seq"]].assign(para=L.paragraphs(rows, float(page["gap"].iloc[0]), lambda t: bool(item.match(t))))

    return _by_page(lines, "para int", make)


def caption_targets(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, target): the seq of the picture or table that each caption (kind, text, box) belongs to."""

    def make(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq").reset_index(drop=True)
        page["box"] = _boxes(page)
        captions, targets = page[page["kind"] == "caption"], page[page["kind"].isin(["image", "table"])].reset_index(drop=True)
        found = L.caption_targets(list(zip(captions["box"], captions["text"])), [(b, k == "table") for b, k in zip(targets["box"], targets["kind"])])
        return captions[["doc_id", "page", "seq"]].assign(target=pd.array([None if k is None else int(targets["seq"][k]) for k in found], dtype="Int64"))

    return _by_page(blocks, "target long", make)
