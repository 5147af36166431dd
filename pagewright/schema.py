"""The tables the operators work on. Block order is ``seq``; boxes are four flat columns; offsets count code points."""

from __future__ import annotations

KINDS = ("title", "authors", "heading", "paragraph", "list_item", "quote", "caption", "footnote", "reference", "table", "image", "furniture")
TEXT_KINDS = ("paragraph", "list_item", "quote", "heading", "title", "caption", "footnote", "reference", "authors")

STYLE = "start int, end int, bold boolean, italic boolean, superscript boolean, subscript boolean, math boolean"
BLOCK = (
    "doc_id string, block_id string, seq int, kind string, text string, page int, x0 double, y0 double, x1 double, y1 double, level int,"
    " font_size double, source string, caption_for string, footnote_label string, bold boolean, italic boolean, font string, n_lines int,"
    " styles array<struct<start int, end int, bold boolean, italic boolean, superscript boolean, subscript boolean, math boolean>>"
)
WORD_CONF = "doc_id string, block_id string, start int, end int, confidence double"
PAGE = (
    "doc_id string, page int, width double, height double, kind string, ocr_used boolean, text_source string, source_page int, side string, unusual_layout boolean"
)
CORRECTION = (
    "doc_id string, correction_id string, block_id string, start int, end int, original string, replacement string, confidence double, status string, source string, latex string"
)
RAW_LINE = (
    "doc_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, block_no int, source string, bold boolean, italic boolean, font string"
)
OCR_WORD = "page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, block int, par int, line int"
CELL = "doc_id string, table_id string, row int, col int, text string, header_rows int, min_conf double"
PAGE_WORD = "doc_id string, n int, page int, text string, rects array<struct<x0 double, y0 double, x1 double, y1 double>>"
HIGHLIGHT = "doc_id string, start int, end int, colour string, words string, note string"
REQUEST_LOG = (
    "task string, provider string, model string, items int, prompt string, answer string, input_tokens long, output_tokens long, cached_tokens long, error string, ts timestamp"
)
