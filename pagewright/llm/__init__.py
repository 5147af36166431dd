"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` holds
the registered queries and ``oracles.ORACLES`` their SQL.
"""
