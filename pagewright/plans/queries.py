"""The registered queries of the library."""

from __future__ import annotations

from . import citations, further, ingest, more, quality, spelling, structure, text  # noqa: F401  (register their queries)
from .registry import QUERIES  # noqa: F401

FLAGSHIP = "e02_block_language"
