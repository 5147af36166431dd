"""Export by the name of a format."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import compose
from .epub import epub_files

FORMATS = {"txt": compose.text_files, "md": compose.markdown_files, "epub": epub_files}


def export(items: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content) in a format: txt, md or epub. PDF and Word files need libraries that aren't here."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format: {fmt}")
    return FORMATS[fmt](items)
