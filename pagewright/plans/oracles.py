"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .registry import ORACLES  # noqa: F401
