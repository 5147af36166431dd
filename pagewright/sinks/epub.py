"""Books: one EPUB a document, packed by the task that holds its items."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.compose import chapters

_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{title}</title></head><body>{body}</body></html>'
_UNSAFE = {c: None for c in range(32) if c not in (9, 10, 13)}


def _safe(text: str) -> str:
    return html.escape((text or "").translate(_UNSAFE), quote=False)


def _item(kind: str, level: int, text: str, anchor: str) -> str:
    t = _safe(text)
    if kind in ("title", "heading", "box_heading"):
        n = 1 if kind == "title" else min(6, int(level or 1) + 1)
        return f'<h{n} id="{anchor}">{t}</h{n}>'
    if kind == "table":
        rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r.split("\t")) + "</tr>" for r in t.split("\n"))
        return f"<table>{rows}</table>"
    return {"quote": f"<blockquote><p>{t}</p></blockquote>", "caption": f"<p><i>{t}</i></p>", "list_item": f"<ul><li>{t}</li></ul>"}.get(kind, f"<p>{t}</p>")


def pack(items: list[tuple[int, str, int, str]], title: str, lang: str = "en") -> bytes:
    """A book from (chapter, kind, level, text) in order; headings get anchors, and the table of contents nests by level."""
    pages: dict[int, list[str]] = {}
    contents: list[tuple[int, str, str]] = []
    for k, (chapter, kind, level, text) in enumerate(items):
        anchor = f"h{k}"
        pages.setdefault(chapter, []).append(_item(kind, level, text, anchor))
        if kind in ("title", "heading"):
            contents.append((0 if kind == "title" else int(level or 1), _safe(text), f"c{chapter}.xhtml#{anchor}"))
    nav, open_levels = "", []
    for level, text, link in contents:
        while open_levels and open_levels[-1] > level:
            nav += "</li></ol>"
            open_levels.pop()
        if open_levels and open_levels[-1] == level:
            nav += "</li>"
        else:
            nav += "<ol>"
            open_levels.append(level)
        nav += f'<li><a href="{link}">{text}</a>'
    nav += "</li></ol>" * len(open_levels)
    names = [f"c{c}" for c in pages]
    manifest = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    package = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{_safe(title)}</dc:identifier><dc:title>{_safe(title)}</dc:title><dc:language>{lang}</dc:language></metadata><manifest>{manifest}'
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>' + "".join(f'<itemref idref="{n}"/>' for n in names) + "</spine></package>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("OEBPS/book.opf", package)
        put("OEBPS/nav.xhtml", _PAGE.format(lang=lang, title=_safe(title), body=f'<nav epub:type="toc">{nav}</nav>'))
        for c, body in pages.items():
            put(f"OEBPS/c{c}.xhtml", _PAGE.format(lang=lang, title=_safe(title), body="\n".join(body)))
    return out.getvalue()


def epub_files(items: DataFrame) -> DataFrame:
    """(doc_id, content) of items (doc_id, seq, kind, text, level); a document is one group."""
    kind = dict(items.dtypes)["doc_id"]

    def make(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("seq")
        rows = list(zip(book["chapter"], book["kind"], book["level"].fillna(1), book["text"]))
        title = next((t for _, k, _, t in rows if k == "title"), str(book["doc_id"].iloc[0]))
        return pd.DataFrame({"doc_id": [book["doc_id"].iloc[0]], "content": [pack(rows, title)]})

    return chapters(items).groupBy("doc_id").applyInPandas(make, f"doc_id {kind}, content binary")
