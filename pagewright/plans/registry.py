"""Queries by name, with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The documents' lines, as a common table expression for the SQL.
BLOCKS = """blocks as (
  select doc_id, unnest(generate_series(0, len(x) - 1)) as seq, unnest(x) as text
  from (select doc_id, string_split(text, chr(10)) as x from documents)
)"""


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
